"""SimHash near-duplicates by multi-index hashing.

Fingerprints: 64 bits; the XXH64 of every 2-word shingle of the whole text, repeats included, votes on each bit.
Rows with one fingerprint form a class, aggregated before anything is compared. Classes are compared by multi-index
hashing: the fingerprint is cut into segments; two that differ in at most `radius` bits differ in at most r_i bits
of some segment i, where the r_i sum to radius + 1 less the number of segments. So every class is looked up under
all values in the Hamming ball of radius r_i around its segment, and candidates are verified on all 64 bits. A pair
found by several segments counts for the first alone. The number of segments is that of least cost for the number
of classes, so table buckets stay short as the corpus grows; buckets that are long all the same are split by a salt, over which their lookups
fan out. Found links are summed and reduced to forests inside the tasks that find them.

Defined results: null texts and texts without words have fingerprint zero, which links like any other; a text of one
word is one shingle; repeated rows are other rows of the same class; a null id takes part and counts, and the
component id is the smallest id that is not null (null if none). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.graphs import joined, labels_of, reduced
from millrace.session import drop_written, fresh, written

HOT = 4096  # rows of a table bucket before it is split
MOST_SEGMENTS = 4
LOOKUP, CANDIDATE = 1.5, 0.015  # microseconds, about
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, size: int = 2) -> int:
    """The fingerprint as a signed 64-bit number."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: A-Z alone, and the six ASCII white spaces
    if not words:
        return 0
    if len(words) <= size:
        shingles: Iterator[bytes] = iter((b" ".join(words),))
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
        n = len(words) - size + 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, 42) for s in shingles), np.uint64, n)
    octets = h.view(np.uint8).reshape(n, 8)
    votes = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column, size: int = 2) -> Column:
    """fingerprint() of a text column."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(t, size) for t in batch], dtype="int64")

    return of(text)


def _cut_into(m: int, radius: int) -> list[tuple[int, int, int]]:
    """m segments of like length; their radii sum to radius + 1 - m."""
    base, extra = divmod(radius + 1 - m, m)
    out, shift = [], 0
    for i in range(m):
        n = 64 // m + (i < 64 % m)
        out.append((shift, n, base + (i < extra)))
        shift += n
    return out


def segments(classes: int, radius: int) -> list[tuple[int, int, int]]:
    """(shift, bits, radius) of each segment for so many distinct fingerprints: the number of segments that costs least.

    A fingerprint is looked up once for each mask of each ball, and meets classes / 2^bits others each time. Few long
    segments mean many lookups, many short ones long buckets; the best length rises with log2(classes). No more than
    MOST_SEGMENTS, as short segments have hot values.
    """

    def cost(parts: list[tuple[int, int, int]]) -> float:
        return sum(sum(comb(n, k) for k in range(r + 1)) * (LOOKUP + CANDIDATE * classes / 2**n) for _, n, r in parts)

    return min((_cut_into(m, radius) for m in range(min(2, radius + 1), max(min(MOST_SEGMENTS, radius + 1), -(-radius // 3)) + 1)), key=cost)


def ball(bits: int, radius: int) -> list[int]:
    """All masks of at most `radius` of so many bits."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def near_pairs(classes: DataFrame, radius: int, hot: int = HOT) -> DataFrame:
    """All pairs (a, b, n_a, n_b) of fingerprints a < b at most `radius` bits apart, each once, of a table (fp, n) of distinct fingerprints."""
    parts = segments(classes.count(), radius)
    cut = lambda x, shift, bits: F.shiftrightunsigned(x, shift).bitwiseAND(F.lit((1 << bits) - 1))
    tag = lambda i, value: F.lit(i << 56).bitwiseOR(value)
    fp = F.col("fp")
    # Segment values have at most 64 bits; a lone segment of 64 bits holds the key without a tag.
    if len(parts) == 1:
        tag = lambda i, value: value
        cut = lambda x, shift, bits: x
    keys = F.array(*(tag(i, cut(fp, s, n)) for i, (s, n, _) in enumerate(parts)))
    table = classes.select(F.explode(keys).alias("key"), fp.alias("b"), F.col("n").alias("n_b"))
    looked = None
    for i, (s, n, r) in enumerate(parts):
        masks = [m - (1 << 64) if m >> 63 else m for m in ball(n, r)]
        one = classes.select("fp", "n", F.explode(F.array(*map(F.lit, masks))).alias("mask") if len(masks) < 400 else F.explode(F.from_json(F.lit(str(masks)), "array<long>")).alias("mask"))
        one = one.select(F.col("fp").alias("a"), F.col("n").alias("n_a"), tag(i, cut(fp, s, n).bitwiseXOR(F.col("mask"))).alias("key"))
        looked = one if looked is None else looked.unionByName(one)
    crowded = table.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > hot).select("key", F.ceil(F.col("size") / hot).cast("int").alias("salts"))
    crowded = written(crowded, "crowded")
    if number := crowded.count():
        crowded = F.broadcast(crowded) if number <= 100_000 else crowded
        table = table.join(crowded, "key", "left").select("key", "b", "n_b", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
        looked = looked.join(crowded, "key", "left").select("key", "a", "n_a", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
        on = ["key", "salt"]
    else:
        on = ["key"]
    differ = F.col("a").bitwiseXOR(F.col("b"))
    within = [F.bit_count(cut(differ, s, n)) <= r for s, n, r in parts]
    first = F.lit(False)
    for i in range(len(parts)):
        mine = F.lit(True) if len(parts) == 1 else F.shiftrightunsigned("key", 56) == i
        for earlier in within[:i]:
            mine = mine & ~earlier
        first = first | mine
    return looked.join(table, on).where((F.col("a") < F.col("b")) & (F.bit_count(differ) <= radius) & first).select("a", "b", "n_a", "n_b")


def _found(df: DataFrame, id_col: str, text: str, radius: int, size: int) -> tuple[DataFrame, DataFrame]:
    """(rows (id, h: XXH64 of the text, node: fingerprint) of df, labels of the nodes and n: rows of each)."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("h"), fingerprint_column(F.col(text), size).alias("node"))
    rows = written(rows, "fingerprints")
    classes = written(rows.groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("first")), "classes")
    links = written(reduced(near_pairs(classes.select(F.col("node").alias("fp"), "n"), radius)), "links")
    labels = labels_of(classes, links)
    drop_written(links)
    drop_written(classes)
    return rows, labels


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = 6, size: int = 2) -> DataFrame:
    """One row for each row of df: id, fp, n_near (other rows linked directly), component_id (smallest id reachable by links).

    Columns of df other than the id are not carried; join on the id. Named as the first is in df.
    """
    rows, labels = _found(df, id_col, text, radius, size)
    return joined(rows, labels, ["node"]).select(F.col("id").alias(id_col), F.col("node").alias("fp"), F.col("n_links").alias("n_near"), "component_id")


def hex_digits(fp: Column) -> Column:
    """A fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = 6) -> DataFrame:
    """df with one row of each group of near-duplicates: that of the smallest id, null ids last. Columns stay as they are.

    Of rows of that id, the one with the least XXH64 of the text stays, and of rows alike in both any one. The texts are
    shuffled once, by id and hash, whatever the number of rows that stay.
    """
    rows, labels = _found(df, id_col, text, radius, 2)
    place = F.struct(F.col("id").isNull(), "id", "h")
    first = joined(rows, labels.select("node", "root", "n"), ["node"]).groupBy("root").agg(F.min(place).alias("first"))
    id_, hash_, h_, row_ = fresh(df, "id", "hash", "h", "row")
    kept = written(first.select(F.col("first.id").alias(id_), F.col("first.h").alias(hash_)), "kept")
    repeated = rows.join(kept, rows["id"].eqNullSafe(kept[id_]) & (rows["h"] == kept[hash_]), "left_semi").groupBy("id", "h").agg(F.count("*").alias("n")).where("n > 1")
    repeated = written(repeated.select(F.col("id").alias(id_), F.col("h").alias(hash_)), "repeated")
    hashed = df.withColumn(h_, F.coalesce(F.xxhash64(text), F.lit(0)))
    mine = lambda t: F.col(id_col).eqNullSafe(t[id_]) & (F.col(h_) == t[hash_])
    single = kept
    if several := not repeated.isEmpty():
        single = kept.join(repeated.select(F.col(id_).alias(f"{id_}2"), F.col(hash_).alias(f"{hash_}2")), F.col(id_).eqNullSafe(F.col(f"{id_}2")) & (F.col(hash_) == F.col(f"{hash_}2")), "left_anti")
    columns = [F.col(f"`{c}`") for c in df.columns]
    out = hashed.join(single.hint("shuffle_hash"), mine(single), "left_semi").select(*columns)
    if several:
        whole = F.struct(*columns)
        again = hashed.join(repeated.hint("shuffle_hash"), mine(repeated), "left_semi").groupBy(F.col(id_col).alias(id_), h_).agg(F.any_value(whole).alias(row_))
        out = out.unionByName(again.select(f"{row_}.*"))
    return out
