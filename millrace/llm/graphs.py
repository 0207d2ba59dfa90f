"""Links between nodes: counting them, reducing them to forests, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import drop_written, written

FLUSH = 2_000_000
ONE_TASK = 1_000_000  # links of 16 bytes
REDUCED = "node long, other long, links long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) with the same components as a-b; one for each node that is no root. The root is the smallest node."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[u], label[v]
        low, high = np.minimum(x, y), np.maximum(x, y)
        open_ = low != high
        if not open_.any():
            break
        np.minimum.at(label, high[open_], low[open_])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        u, v = u[open_], v[open_]
    inner = label != np.arange(len(nodes))
    return nodes[inner], nodes[label[inner]]


class Reducer:
    """Takes batches of links with the weights of their ends; gives link counts by node and a forest, never the links."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0
        self.tree = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def add(self, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> Iterator[pa.RecordBatch]:
        """of_a: what the link adds to the count of a; of_b likewise."""
        if len(a):
            self.parts.append((a, b, of_a, of_b))
            self.size += len(a)
        if self.size >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        a, b, of_a, of_b = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        sums = np.bincount(at, np.concatenate((of_a, of_b)), len(nodes)).astype(np.int64)
        yield _batch(nodes, nodes, sums)
        self.tree = forest(np.concatenate((a, self.tree[0])), np.concatenate((b, self.tree[1])))
        if len(self.tree[0]) >= FLUSH:
            yield from self.end()

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from self.flush()
        x, y = self.tree
        if len(x):
            self.tree = (x[:0], y[:0])
            yield _batch(x, y, np.zeros(len(x), np.int64))


def _batch(node: np.ndarray, other: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(other, pa.int64()), pa.array(links, pa.int64())], names=["node", "other", "links"])


def reduced(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, n_a, n_b) of linked nodes, each pair once, that stand for n_a and n_b rows, as rows (node, other, links).

    Rows with node = other carry link counts to be summed; the others are links with the same components. Every task
    sums and reduces what it reads, so that pairs within a large group stay in the task that finds them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Reducer()
        for x in batches:
            a, b, n_a, n_b = (x.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            yield from r.add(a, b, n_b, n_a)
        yield from r.end()

    return pairs.select("a", "b", "n_a", "n_b").mapInArrow(run, REDUCED)


def joined(rows: DataFrame, table: DataFrame, keys: list[str], n: str = "n", share: int = 1_000, least: int = 10_000) -> DataFrame:
    """rows joined with a table (keys, n: rows of each key, ...) of distinct keys, without n. Keys of more than a thousandth of all rows, of which there are less than a thousand, meet them by broadcast, wherever these are."""
    total = table.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    limit = max(least, total // share)
    hot = table.where(F.col(n) > limit).drop(n)
    if hot.isEmpty():
        return rows.join(table.drop(n), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.where(F.col(n) <= limit).drop(n), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def link_counts(rows: DataFrame) -> DataFrame:
    """(node, links) of a reduced() table."""
    return rows.where("node = other").groupBy("node").agg(F.sum("links").alias("links"))


def components(rows: DataFrame) -> DataFrame:
    """(node, root) for every node of a reduced() table that has a link; root is the smallest node of its component.

    Alternating large-star and small-star steps: each is a minimum by node, aggregated before the shuffle, and a join
    back. Each round is written to the shared folder. A round that changes nothing ends it; the number of rounds
    grows with the logarithm of the number of nodes. At most ONE_TASK links, counted first, are joined in one task instead.
    """
    edges = written(rows.where("node <> other").select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v")).distinct(), "links")
    mark = _mark(edges)
    if mark[0] <= ONE_TASK:
        return edges.coalesce(1).mapInArrow(_rooted, "node long, root long")
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = joined(both, low, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        met = joined(large, low, ["u"])
        small = met.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(met.select("u", F.col("m").alias("v")))
        after = written(small.where("u <> v").distinct(), "links")
        drop_written(edges)
        edges, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    links = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    if links:
        node, root = forest(*(np.concatenate(c) for c in zip(*links, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Number of links and an order-free digest of them."""
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_000_007), F.lit(0))).first()
    return row[0], row[1]


def labels_of(classes: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, n, root, n_links, component_id) for classes (node, n, first: least id) and their reduced() links.

    n_links counts the other rows of the own class and all rows of linked classes; component_id is the least id reachable.
    """
    found = classes.join(link_counts(rows), "node", "left").join(components(rows), "node", "left")
    found = written(found.select("node", "first", F.col("n").alias("rows"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")), "rooted")
    least = found.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    out = written(joined(found, least, ["root"]).select("node", F.col("rows").alias("n"), "root", "n_links", "component_id"), "found")
    drop_written(found)
    return out
