"""Mixing sources to target weights by hierarchical budgeting.

A tree of domains, languages and sources carries weights; a leaf is one source in one language of one domain. The token
budget runs down the tree, each node's share in proportion to its weight among its siblings that have data. A leaf can
give at most `epochs` passes over its tokens; what it falls short of goes to its siblings by their weights, and only
what all of them cannot give goes up to the siblings of their parent, and so on to the root.

Within a leaf, epoch e is an order by a seeded hash of epoch and id; the epochs follow one another, and the leaf's
selection is the longest prefix of whole documents within its budget. What it falls short of then, less than its next
document, goes the same way: to siblings whose next documents it pays for, the least filled first, then to those of the parent's
siblings, until none is left that fits (of the next documents, those in the range of the hash in which the budget ended are seen, NEXT at most). Prefixes are found without sorting leaves: a
histogram of tokens by ranges of the hash tells which ranges are in and which are out, and only the range in which
the budget ends is put in order. Ranges are as many as the leaf needs for each to fit one task, so a leaf with a third of
all rows is no different.

Defined results: null keys are a node named by the null; leaves without a weight get none of the budget (default
weight given: that); leaves of no tokens give nothing; a null id or text is a row like others; repeated rows are
selected each, in the order of their texts' hashes, and rows alike in both go together or not at all. An empty table or
a budget of 0 gives an empty result.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import fresh, written

PER_RANGE = 20_000  # rows of a range of the hash, about
MOST_LEAVES = 50_000  # beyond, the leaves' plan is joined by shuffle instead of broadcast
NEXT, ALL_NEXT = 64, 1_000_000  # next documents seen of a leaf, and of all
Key = tuple[object, ...]


def split_budget(budget: float, capacity: Mapping[Key, float], weight: Mapping[Key, float], default: float = 1.0) -> dict[Key, float]:
    """Tokens for each leaf. Keys of capacity are paths of one length; weights go by path prefix, in proportion among siblings."""

    depth = max((len(k) for k in capacity), default=0)
    out: dict[Key, float] = {}
    room: dict[Key, float] = defaultdict(float)
    children: dict[Key, set[Key]] = defaultdict(set)
    for k, c in capacity.items():
        part = c  # what can be reached from a node through positive weights
        for d in range(depth, -1, -1):
            room[k[:d]] += part
            if d and weight.get(k[:d], default) <= 0:
                part = 0
            if d:
                children[k[: d - 1]].add(k[:d])

    def give(node: Key, amount: float) -> None:
        if len(node) == depth:
            out[node] = min(amount, capacity[node])
            return
        kids = sorted(children[node], key=str)
        share = dict.fromkeys(kids, 0.0)
        left, open_ = amount, [k for k in kids if weight.get(k, default) > 0 and room[k] > 0]
        while left > 1e-9 and open_:  # what a full child cannot take goes to its siblings
            total = sum(weight.get(k, default) for k in open_)
            full = {k for k in open_ if share[k] + left * weight.get(k, default) / total >= room[k] - 1e-9}
            if not full:
                for k in open_:
                    share[k] += left * weight.get(k, default) / total
                break
            for k in full:
                left -= room[k] - share[k]
                share[k] = room[k]
            open_ = [k for k in open_ if k not in full]
        for k in kids:
            give(k, share[k])

    if depth:
        give((), min(budget, room[()]))
    return out


def extended(given: Mapping[Key, float], taken: Mapping[Key, float], following: Mapping[Key, Sequence[int]]) -> dict[Key, int]:
    """How many of its following documents (by their tokens) each leaf takes besides, paid for by what leaves fall short of: given less taken. Siblings come before ancestors."""
    depth = max((len(k) for k in given), default=0)
    more = dict.fromkeys(given, 0)
    held = {k: float(taken[k]) for k in given}
    children: dict[Key, set[Key]] = defaultdict(set)
    for k in given:
        for d in range(depth, 0, -1):
            children[k[: d - 1]].add(k[:d])

    def settle(node: Key) -> tuple[float, list[Key]]:
        if len(node) == depth:
            return max(0.0, given[node] - taken[node]), [node] if given[node] > 0 else []
        below = [settle(k) for k in sorted(children[node], key=str)]
        pool, leaves = sum(p for p, _ in below), [k for _, x in below for k in x]
        open_ = [(held[k] / given[k], str(k), k) for k in leaves if more[k] < len(following.get(k, ()))]
        heapq.heapify(open_)
        while open_:
            _, name, k = heapq.heappop(open_)
            n = following[k][more[k]]
            if n > pool + 1e-6:
                continue
            pool -= n
            held[k] += n
            more[k] += 1
            if more[k] < len(following[k]):
                heapq.heappush(open_, (held[k] / given[k], name, k))
        return pool, leaves

    if depth:
        settle(())
    return more


def seeded(seed: int, epoch: Column, id_col: Column) -> Column:
    """15 hexadecimal digits of MD5 over seed, epoch and id, as a number below 2^60; any SQL engine can compute it."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_col.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 15), 16, 10).cast("long")


def words(text: str) -> Column:
    """Number of words of a text, parted by ASCII spaces; the default measure of tokens."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.size(F.filter(F.split(F.translate(t, "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")).cast("long")


def mixed(df: DataFrame, levels: list[Column], weight: Mapping[Key, float], budget: float | None = None, share: float = 1.0, epochs: int = 4, seed: int = 0, id_col: str = "doc_id", text: str = "text", tokens: Column | None = None, default: float = 1.0, per_range: int = PER_RANGE) -> DataFrame:
    """Rows (id, h, leaf, epoch, n_tokens) of the selection, once for each epoch that takes a row; h is the XXH64 of the text.

    levels: key expressions from the domain to the source. budget: tokens; None: `share` of all tokens. tokens: the
    measure; None: words. Leaves are collected with their sums: as many as there are sources, not rows.
    """
    keys = [k.cast("string").alias(f"k{i}") for i, k in enumerate(levels)]
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("h"), *keys, (tokens if tokens is not None else words(text)).cast("long").alias("n_tokens"))
    names = [f"k{i}" for i in range(len(levels))]
    rows = written(rows.groupBy("id", "h", *names, "n_tokens").agg(F.count("*").alias("copies")), "measured")
    leaves = {tuple(r[n] for n in names): (r["tokens"], r["rows"]) for r in rows.groupBy(*names).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("rows")).collect()}
    total = sum(t for t, _ in leaves.values())
    given = split_budget(total * share if budget is None else budget, {k: t * epochs for k, (t, _) in leaves.items()}, weight, default)
    spark = df.sparkSession
    table = []
    for k in sorted(leaves, key=str):
        t, n = leaves[k]
        amount = int(given[k] + 1e-6)
        full, rest = divmod(amount, t) if t else (0, 0)
        table.append((*k, int(full), int(rest), max(1, -(-n // per_range))))
    schema = ", ".join(f"{n} string" for n in names) + ", full int, rest long, ranges int"
    if not table:
        return spark.createDataFrame([], "id " + dict(rows.dtypes)["id"] + ", h long, leaf string, epoch int, n_tokens long")
    plan = spark.createDataFrame(pd.DataFrame(table, columns=[*names, "full", "rest", "ranges"]).astype({n: object for n in names}), schema)  # one row for each leaf
    if len(table) <= MOST_LEAVES:
        plan = F.broadcast(plan)
    same = [rows[n].eqNullSafe(plan[n]) for n in names]
    on = same[0]
    for s in same[1:]:
        on = on & s
    placed = rows.join(plan, on).select(rows["id"], rows["h"], *(rows[n] for n in names), "n_tokens", "copies", "full", "rest", "ranges")
    # 2^60 hashes in as many ranges as the leaf has
    last = placed.withColumn("u", seeded(seed, F.col("full"), F.col("id"))).withColumn("range", F.floor(F.col("u") / (F.pow(F.lit(2.0), F.lit(60)) / F.col("ranges"))).cast("int"))
    by = last.groupBy(*names, "range").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("sum"))
    upto = Window.partitionBy(*names).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by = written(by.withColumn("end", F.sum("sum").over(upto)).select(*(F.col(n).alias("r_" + n) for n in names), F.col("range").alias("r_range"), (F.col("end") - F.col("sum")).alias("start"), "end"), "ranges")
    on = F.col("range") == F.col("r_range")
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col("r_" + n))
    last = last.join(by, on)
    whole = last.where((F.col("end") <= F.col("rest")) & (F.col("n_tokens") > 0))
    edge = last.where((F.col("end") > F.col("rest")) & (F.col("start") < F.col("rest")))
    order = Window.partitionBy(*names).orderBy("u", "id", "h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.col("n_tokens") * F.col("copies")
    edge = written(edge.where("n_tokens > 0").withColumn("at", F.col("start") + F.sum(size).over(order)), "edge")  # about per_range rows of a leaf
    out_of = F.col("at") > F.col("rest")
    seen = max(4, min(NEXT, ALL_NEXT // len(table)))
    place = F.sum(out_of.cast("int")).over(Window.partitionBy(*names).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = edge.withColumn("place", place).where(F.col("place") <= seen).groupBy(*names).agg(F.coalesce(F.max(F.when(~out_of, F.col("at"))), F.min("start")).alias("taken"), F.array_sort(F.collect_list(F.when(out_of, F.col("at")))).alias("next"), F.first("full").alias("full"))
    taken, following, stops = {k: float(int(given[k] + 1e-6)) for k in given}, {}, {}
    for r in ends.collect():  # a row for each leaf
        k = tuple(r[n] for n in names)
        stops[k] = [r["taken"], *r["next"]]
        taken[k] = r["full"] * leaves[k][0] + r["taken"]
        following[k] = [b - a for a, b in zip(stops[k], stops[k][1:])]
    more = extended(given, taken, following)
    if stops:
        upto = spark.createDataFrame([(*k, int(v[more[k]])) for k, v in stops.items()], ", ".join(f"s_{n} string" for n in names) + ", upto long")
        if len(stops) <= MOST_LEAVES:
            upto = F.broadcast(upto)
        on = F.col("at") <= F.col("upto")
        for n in names:
            on = on & F.col(n).eqNullSafe(F.col("s_" + n))
        edge = edge.join(upto, on)
    leaf = F.concat_ws("/", *(F.coalesce(F.col(n), F.lit("null")) for n in names)).alias("leaf")
    out = ["id", "h", leaf, "epoch", "n_tokens", "copies"]
    # Documents without tokens belong to no prefix of tokens' worth; they follow the epochs that are taken whole.
    passes = placed.where("full > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full") - 1))).select(*out)
    part = whole.withColumn("epoch", F.col("full")).select(*out).unionByName(edge.withColumn("epoch", F.col("full")).select(*out))
    chosen = passes.unionByName(part)
    return chosen.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")


def select_mixed(df: DataFrame, levels: list[Column], weight: Mapping[Key, float], id_col: str = "doc_id", text: str = "text", **options: object) -> DataFrame:
    """df's rows as the mix takes them, a row once for each epoch that takes it. Columns stay as they are.

    The texts are shuffled once, by id; the selection joins them as counts of epochs.
    """
    id_, hash_, times_, h_, time_ = fresh(df, "id", "hash", "times", "h", "time")
    chosen = mixed(df, levels, weight, id_col=id_col, text=text, **options)
    chosen = chosen.groupBy("id", "h", "epoch").agg(F.count("*").alias("rows")).groupBy(F.col("id").alias(id_), F.col("h").alias(hash_)).agg(F.count("*").cast("int").alias(times_))
    joined = df.withColumn(h_, F.coalesce(F.xxhash64(text), F.lit(0))).join(written(chosen, "chosen").hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(h_) == F.col(hash_)))
    return joined.withColumn(time_, F.explode(F.sequence(F.lit(1), F.col(times_)))).select(*(F.col(f"`{c}`") for c in df.columns))
