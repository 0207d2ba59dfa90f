"""Embedding near-duplicates by an inverted multi-index.

Each half of the unit vectors has a codebook of its own, fitted on a bounded sample; the product of the two is a grid
of cells, and every vector is listed in its cell. A search visits cells in the order of the sum of the two halves'
distances (multi-sequence order) and verifies what it finds by cosine in double precision. How many cells to visit is
calibrated: samples of vectors are compared with all other rows, in blocks, until enough of them have a true
neighbour, and the number is the least at which the target share of these is reached, doubled. Where links are too
rare for that, made partners at the threshold itself count too, so that the number is that of the farthest links.

Searches go out from every vector. Cells are grouped by their first code; a vector is sent once to each group it
visits. Groups with many residents or visitors are split into a grid of blocks. A pair that both sides find counts
for one of them. Rows of equal vectors are one class before anything is compared. Found links are summed and reduced
to forests inside the tasks that find them. Vectors of different lengths have no cosine: the commonest
length has an index, and so have up to FEW - 1 others of at least SMALL vectors. Of all further lengths, all vectors of a length are
compared in blocks, so that any number of lengths costs one job.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; they are their own
component. Repeated rows link with each other. A null id takes part; component ids are least non-null ids. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.graphs import REDUCED, Reducer, joined, labels_of
from millrace.session import drop_written, written

SAMPLE = 65_536  # vectors that codebooks are fitted on, at most
PROBES = 2_048  # vectors that calibration searches for at first
MOST_PROBES = 65_536  # and at most, while fewer than ENOUGH have a neighbour
ENOUGH = 256
CELL = 32  # vectors a cell should hold on average
RESIDENTS, VISITORS = 20_000, 200_000  # of a block, about
BLOCK = 1_024
MOST_SUMS = 4_000_000  # sums of two distances held at once
FEW, SMALL = 8, 4_096  # lengths with an index at most, and vectors below which a length but the commonest has none
CODES = 4_096  # centroids of a codebook, at most


def usable(v: Column) -> Column:
    """Whether a vector can have a cosine."""
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & good & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of an array column as unit vectors, scaled by their greatest component first so that no square overflows or vanishes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codebook(x: np.ndarray, size: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Centroids by k-means; those that lose all points stay where they are."""
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(size, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = distances(x, centers).argmin(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centers))
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances less |x|^2, which no order depends on."""
    return (centers * centers).sum(axis=1) - 2 * (x @ centers.T)


class Grid:
    """Two codebooks; cells are first code * size of the second codebook + second code."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = first, second
        self.half = first.shape[1]
        self.places: tuple = (None,)  # cells, and the places that visits() compares for so many

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if x.shape[1] == self.half:  # vectors of one component have no second half
            return distances(x, self.first), np.zeros((len(x), len(self.second)))
        return distances(x[:, : self.half], self.first), distances(x[:, self.half :], self.second)

    def home(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return a.argmin(axis=1) * len(self.second) + b.argmin(axis=1)

    def visits(self, x: np.ndarray, cells: int) -> np.ndarray:
        """The first `cells` cells of each row's multi-sequence traversal, nearest first.

        The k-th cell the traversal pops lies at places (i, j) of the two sorted lists with (i + 1)(j + 1) <= k, so only
        such places are compared.
        """
        a, b = self.halves(x)
        cells = min(cells, a.shape[1] * b.shape[1])
        if self.places[0] != cells:
            rows = [np.arange(min(cells // (k + 1), b.shape[1])) for k in range(min(cells, a.shape[1]))]
            self.places = cells, np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
        _, i, j = self.places
        out = np.empty((len(x), cells), np.int64)
        step = max(1, MOST_SUMS // len(i))
        for s in range(0, len(x), step):
            c, d = a[s : s + step], b[s : s + step]
            oa, ob = c.argsort(axis=1, kind="stable")[:, :cells], d.argsort(axis=1, kind="stable")[:, :cells]
            sums = np.take_along_axis(c, oa, 1)[:, i] + np.take_along_axis(d, ob, 1)[:, j]
            best = sums.argsort(axis=1, kind="stable")[:, :cells]
            out[s : s + step] = np.take_along_axis(oa[:, i] * len(self.second) + ob[:, j], best, 1)
        return out

    def ranks(self, a: np.ndarray, b: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many cells one vector's traversal (a, b its distances) visits before each of `cells`."""
        sorted_b = np.sort(b)
        i, j = np.divmod(cells, len(self.second))
        limits = (a[i] + b[j])[:, None] - a[None, :] - 1e-9  # of equal sums, none is before another
        return np.searchsorted(sorted_b, limits.ravel(), side="left").reshape(limits.shape).sum(axis=1)


def _arrow(df: DataFrame, n: int) -> pa.Table:
    """At most n rows, by a hash of the node: the bounded sample of fitting and calibration."""
    return df.orderBy(F.xxhash64("node"), "node").limit(n).toArrow()


def fitted(classes: DataFrame, number: int, cell: int = CELL, sample: int = SAMPLE) -> Grid:
    """The grid for so many classes (node, v): codebooks of about sqrt(number / cell) centroids, CODES at most."""
    x = unit(_arrow(classes.select("node", "v"), sample).column("v"))
    half = max(1, x.shape[1] // 2)
    size = int(np.clip(np.ceil(np.sqrt(number / cell)), 2, CODES))
    second = x[:, half:] if x.shape[1] > 1 else np.zeros((len(x), 1))
    return Grid(codebook(x[:, :half], size), codebook(second, size, seed=1))


def _found(classes: DataFrame, grid: Grid, nodes: np.ndarray, q: np.ndarray, threshold: float) -> Counter[int]:
    """The probes' neighbours but themselves, by the rank of their cells; each probe that has any sums to 1."""
    shared = classes.sparkSession.sparkContext.broadcast((grid, nodes, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, own, probes = shared.value
        a, b = g.halves(probes)
        counts: Counter[tuple[int, int]] = Counter()
        for batch in batches:
            if not batch.num_rows:
                continue
            node, x = batch.column(0).to_numpy(), unit(batch.column(1))
            home = g.home(x)
            for s in range(0, len(probes), BLOCK):
                near = probes[s : s + BLOCK] @ x.T >= threshold
                for p in np.flatnonzero(near.any(axis=1)):
                    cells, n = np.unique(home[near[p] & (node != own[s + p])], return_counts=True)
                    if len(cells):
                        for r, k in zip(g.ranks(a[s + p], b[s + p], cells).tolist(), n.tolist(), strict=True):
                            counts[int(s + p), r] += k
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.int64()), pa.array([k[1] for k in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["probe", "rank", "n"])

    by = classes.select("node", "v").mapInArrow(run, "probe long, rank long, n long").groupBy("probe", "rank").agg(F.sum("n").alias("n"))
    share = by.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("probe")))
    return Counter({r["rank"]: r["share"] for r in share.groupBy("rank").agg(F.sum("share").alias("share")).collect()})


def _least(ranks: Counter[int], target: float) -> int:
    """Cells that hold the target share."""
    total, found = sum(ranks.values()), 0.0
    for rank in sorted(ranks):
        found += ranks[rank]
        if found >= target * total - 1e-9:
            return rank + 1
    return 0


def _partners(grid: Grid, q: np.ndarray, threshold: float) -> Counter[int]:
    """Ranks of partners at the threshold, each on the way from a probe to the next."""
    away = np.roll(q, 1, axis=0)
    away = away - (away * q).sum(axis=1, keepdims=True) * q
    norm = np.linalg.norm(away, axis=1)
    q, away = q[norm > 1e-6], away[norm > 1e-6] / norm[norm > 1e-6, None]
    if not len(q):
        return Counter()
    home = grid.home(threshold * q + math.sqrt(max(0.0, 1 - threshold * threshold)) * away)
    a, b = grid.halves(q)
    return Counter(int(grid.ranks(a[k], b[k], home[k : k + 1])[0]) for k in range(len(q)))


def calibrated(classes: DataFrame, grid: Grid, threshold: float, target: float, probes: int = PROBES) -> int:
    """Cells to visit: the least number that finds the target share of the probes' neighbours (each probe that has any weighs the same), doubled; 8 at least.

    Probes are added until ENOUGH have a neighbour besides themselves, up to MOST_PROBES or all classes. Where MOST_PROBES
    do not suffice, the number is no less than that for made partners at the threshold.
    """
    ranks: Counter[int] = Counter()
    asked, limit = 0, probes
    while True:
        rows = _arrow(classes.select("node", "v"), limit)
        nodes, q = rows.column("node").to_numpy(), unit(rows.column("v"))
        ranks.update(_found(classes, grid, nodes[asked:], q[asked:], threshold))
        asked = len(q)
        if asked < limit or sum(ranks.values()) >= ENOUGH:
            return max(8, 2 * _least(ranks, target))
        if limit >= MOST_PROBES:
            return max(8, 2 * _least(ranks, target), 2 * _least(_partners(grid, q[:probes], threshold), target))
        limit = min(MOST_PROBES, 8 * limit)


def _copies(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, number of the copy) for each of so many copies of 0, 1, 2, ..."""
    which = np.repeat(np.arange(len(times)), times)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)


def _mixed(node: np.ndarray, factor: int, shift: int) -> np.ndarray:
    return ((node.astype(np.uint64) * np.uint64(factor)) >> np.uint64(shift)).astype(np.int64)


def _spread(batches: Iterator[pa.RecordBatch], grid: Grid, cells: int, splits: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    """Each vector as a resident of its home cell's group and as a visitor of every group it visits; without splits, the number of both by group."""
    width = len(grid.second)
    for batch in batches:
        if not batch.num_rows:
            continue
        visits = grid.visits(unit(batch.column(2)), cells)
        home = visits[:, 0]
        first, second = np.divmod(visits, width)
        order = first.argsort(axis=1, kind="stable")
        first, second = (np.take_along_axis(x, order, 1) for x in (first, second))
        new = np.ones(first.shape, bool)
        new[:, 1:] = first[:, 1:] != first[:, :-1]
        starts = np.flatnonzero(new.ravel())
        row, group = starts // first.shape[1], first.ravel()[starts]  # of each pair of a vector and a group it visits
        if splits is None:
            for kind, groups in ((0, home // width), (1, group)):
                n = np.bincount(groups)
                i = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.full(len(i), kind)), pa.array(n[i])], names=["i", "kind", "n"])
            continue
        base, rs, qs = splits
        node = batch.column(0).to_numpy()
        r, q = _mixed(node, 0x9E3779B1, 7), _mixed(node, 0x85EBCA77, 9)
        mine = home // width
        at, z = _copies(qs[mine])
        residents = (at, (base[mine] + r % rs[mine] * qs[mine])[at] + z, pa.array(home % width, pa.int32()), np.arange(len(home) + 1), at)
        pair, z = _copies(rs[group])
        visitors = (row[pair], (base[group] + q[row] % qs[group])[pair] + z * qs[group][pair], pa.array(second.ravel(), pa.int32()), np.append(starts, second.size), pair)
        for kind, (at, grp, values, offsets, lists) in enumerate((residents, visitors)):
            codes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            for s in range(0, len(at), 8192):
                e = slice(s, s + 8192)
                take = batch.take(pa.array(at[e]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grp[e], pa.int64()), pa.array(np.full(take.num_rows, kind, np.int32)), take.column(0), take.column(1), take.column(2), pa.array(home[at[e]], pa.int64()), codes.take(pa.array(lists[e]))],
                    names=["grp", "kind", "node", "n", "v", "home", "js"],
                )


def _verified(batches: Iterator[pa.RecordBatch], grid: Grid, cells: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links between visitors and residents, by group; residents of a group come first."""
    reducer, width = Reducer(), len(grid.second)
    group, parts, held = None, [], None
    for batch in batches:
        groups = batch.column(0).to_numpy()
        kinds = batch.column(1).to_numpy()
        cuts = np.flatnonzero((np.diff(groups) != 0) | (np.diff(kinds) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(groups)], strict=True):
            if a == b:
                continue
            if groups[a] != group:
                group, parts, held = groups[a], [], None
            part = batch.slice(a, b - a)
            node, n, x, home = part.column(2).to_numpy(), part.column(3).to_numpy(), unit(part.column(4)), part.column(5).to_numpy()
            if kinds[a] == 0:
                parts.append((node, n, x, home))
                continue
            if held is None:
                if not parts:
                    continue
                held = [np.concatenate(c) for c in zip(*parts, strict=True)]
                order = held[3].argsort(kind="stable")
                held = [c[order] for c in held]
            js = part.column(6)
            owner = np.repeat(np.arange(len(node)), js.value_lengths().to_numpy())
            j = js.flatten().to_numpy()
            order = j.argsort(kind="stable")
            owner, j = owner[order], j[order]
            codes = held[3] % width
            for one in np.unique(j):
                lo, hi = np.searchsorted(codes, [one, one + 1])
                if lo == hi:
                    continue
                mine = owner[np.searchsorted(j, one) : np.searchsorted(j, one, side="right")]
                for p in range(0, len(mine), BLOCK):
                    who = mine[p : p + BLOCK]
                    for r in range(lo, hi, BLOCK):
                        e = min(hi, r + BLOCK)
                        near = x[who] @ held[2][r:e].T >= threshold
                        u, v = np.nonzero(near)
                        u, v = who[u], v + r
                        back = node[u] > held[0][v]  # found from the greater node: left to the lesser if that visits back
                        if back.any():
                            ask, at = np.unique(v[back], return_inverse=True)
                            seen = grid.visits(held[2][ask], cells)
                            skip = np.zeros(len(u), bool)
                            skip[back] = (seen[at] == home[u[back]][:, None]).any(axis=1)
                            u, v = u[~skip], v[~skip]
                        other = node[u] != held[0][v]
                        u, v = u[other], v[other]
                        yield from reducer.add(node[u], held[0][v], held[1][v], n[u])
    yield from reducer.end()


def linked(classes: DataFrame, threshold: float = 0.9, target: float = 0.995, cells: int | None = None) -> DataFrame:
    """reduced() links between classes (node, n, v) of distinct usable vectors of one length."""
    number = classes.count()
    spark = classes.sparkSession
    if number < 2:
        return spark.createDataFrame([], REDUCED)
    grid = fitted(classes, number)
    cells = cells or calibrated(classes, grid, threshold, target)
    shared = spark.sparkContext.broadcast(grid)
    rows = classes.select("node", "n", "v")
    sizes = rows.mapInArrow(lambda b: _spread(b, shared.value, cells, None), "i long, kind long, n long").groupBy("i", "kind").agg(F.sum("n").alias("n")).collect()
    rs, qs = np.ones(len(grid.first), np.int64), np.ones(len(grid.first), np.int64)
    for r in sizes:
        (qs if r["kind"] else rs)[r["i"]] = max(1, -(-r["n"] // (VISITORS if r["kind"] else RESIDENTS)))
    base = np.concatenate(([0], np.cumsum(rs * qs)[:-1]))
    splits = (base, rs, qs)
    sent = rows.mapInArrow(lambda b: _spread(b, shared.value, cells, splits), f"grp long, kind int, node long, n long, v {dict(classes.dtypes)['v']}, home long, js array<int>")
    blocks = sent.repartition(F.col("grp")).sortWithinPartitions("grp", "kind")
    return blocks.mapInArrow(lambda b: _verified(b, shared.value, cells, threshold), REDUCED)


def _compared(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links between rows (grp, side, node, n, v) of a group: of its blocks 0 and 1, or within its block 2."""
    reducer, group, held = Reducer(), None, {}

    def pairs() -> Iterator[pa.RecordBatch]:
        parts = {side: [np.concatenate(c) for c in zip(*x, strict=True)] for side, x in held.items()}
        within = 2 in parts
        if not within and len(parts) < 2:
            return
        (node, n, x), (other, m, y) = (parts[2],) * 2 if within else (parts[0], parts[1])
        for p in range(0, len(node), BLOCK):
            for r in range(p if within else 0, len(other), BLOCK):
                u, v = np.nonzero(x[p : p + BLOCK] @ y[r : r + BLOCK].T >= threshold)
                u, v = u + p, v + r
                if within:
                    u, v = u[u < v], v[u < v]
                yield from reducer.add(node[u], other[v], m[v], n[u])

    for batch in batches:
        groups, sides = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((np.diff(groups) != 0) | (np.diff(sides) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(groups)], strict=True):
            if a == b:
                continue
            if groups[a] != group:
                yield from pairs()
                group, held = groups[a], {}
            part = batch.slice(a, b - a)
            held.setdefault(int(sides[a]), []).append((part.column(2).to_numpy(), part.column(3).to_numpy(), unit(part.column(4))))
    yield from pairs()
    yield from reducer.end()


def compared(classes: DataFrame, threshold: float, block: int = SMALL) -> DataFrame:
    """reduced() links between classes (node, n, v, k: length) of one length: all pairs, in blocks; a length of more vectors than a block has a grid of blocks."""
    sizes = classes.groupBy("k").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = classes.join(sizes, "k").withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    pair = F.transform(others, lambda o: F.struct(F.xxhash64("k", F.least("b", o), F.greatest("b", o)).alias("grp"), F.when(o == F.col("b"), 2).when(F.col("b") < o, 0).otherwise(1).alias("side")))
    sent = rows.select("node", "n", "v", F.explode(pair).alias("p")).select("p.grp", "p.side", "node", "n", "v")
    return sent.repartition("grp").sortWithinPartitions("grp", "side").mapInArrow(lambda b: _compared(b, threshold), REDUCED)


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, target: float = 0.995) -> DataFrame:
    """One row for each row of df: id, n_links (other rows linked directly), component_id (smallest id reachable), kept (id = component_id)."""
    v = F.col(vector)
    rows = written(df.select(F.col(id_col).alias("id"), F.when(usable(v), v).alias("v")), "vectors")
    good = rows.where("v is not null").withColumn("h", F.xxhash64("v"))
    classes = written(good.groupBy("h", "v").agg(F.count("*").alias("n"), F.min("id").alias("first")).withColumn("node", F.monotonically_increasing_id()), "classes")
    members = joined(good, classes.select("h", "v", "node", "n"), ["h", "v"]).select("id", "node")
    kinds = classes.select("node", "n", "v", F.size("v").alias("k"))
    sizes = kinds.groupBy("k").agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("k")).limit(FEW).collect()
    common = [r["k"] for i, r in enumerate(sizes) if i == 0 or r["c"] >= SMALL]
    found = [linked(kinds.where(F.col("k") == k).select("node", "n", "v"), threshold, target) for k in common]
    rest = kinds.where(~F.col("k").isin(common)) if common else kinds
    if not common or not rest.isEmpty():
        found.append(compared(rest, threshold))
    links = written(reduce(DataFrame.unionByName, found), "links")
    labels = labels_of(classes.select("node", "n", "first"), links)
    drop_written(links)
    found = joined(members, labels, ["node"]).select("id", "n_links", "component_id")
    alone = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return found.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
