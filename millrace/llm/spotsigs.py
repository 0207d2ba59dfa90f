"""SpotSigs document fingerprints.

At each occurrence of a common word (an anchor), the chain of the next content words, every `distance`-th of them,
`length` in number, is a signature; a text's fingerprint is its set of signatures. Likeness is the Jaccard
coefficient of two sets. Near-duplicates are found without comparing all: sets are partitioned by their number of
signatures into ranges so wide that a set can only match sets of its own or the next range; within these, an inverted
index over the rarest signatures of each set brings up candidates, and the Jaccard comparison is pruned by lengths.

The fingerprints of a table are compared in the same way: with those of edited texts and of the next rows, in ranges of set
sizes outside of which no pair can reach LEAST, and without the comparison where the sizes rule it out.

Defined results: a null text counts as empty and has no signatures; two empty sets are alike (1.0), an empty and
another are not (0.0). In fingerprints(), a likeness below its threshold (LEAST) counts as 0.0. A text without a full chain after any anchor takes every word for an anchor; one with fewer
words than a chain is one signature of all its words, or of its characters if it has no words. Equal texts have equal
fingerprints. Ties: rows of one id follow one another by the XXH64 of their texts, null ids come first. Ids are in order of
numbers if they are whole numbers, else in that of their texts' code points; they keep their type.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import part_bytes, written

ANCHORS = frozenset(
    "a an the is are was were be been of and to in that it for on with as by this from or at not he she they we you his her its but have has had which will would there their"
    " le la les un une des du de et en est que qui dans pour par sur au aux pas ne se ce il elle nous vous ou avec plus sont"
    " der die das den dem ein eine einer und in zu ist von mit auf für im nicht sich als auch es an wird bei nach wie aus"
    " el los las una y es por con para del al lo como su no más o pero sus".split()
)
_WORD = re.compile(r"\w+")
LEAST = 0.05  # likeness that fingerprints() tells from none
ID_SAMPLE = 200_000  # ids that are no numbers, at most, from which the bounds of parts are taken
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def signatures(text: str | None, anchors: frozenset[str] = ANCHORS, distance: int = 1, length: int = 2) -> frozenset[str]:
    """The set of signatures of a text."""
    words = _WORD.findall((text or "").lower())
    content = [w for w in words if w not in anchors]
    out = set()
    reach, k, n = distance * length, 0, len(content)
    for w in words:
        if w in anchors:
            if k + reach <= n:
                out.add(" ".join((w, *content[k + distance - 1 : k + reach : distance])))
        else:
            k += 1
    if not out:
        if len(words) > reach:
            out = {" ".join((words[i], *words[i + distance : i + reach + 1 : distance])) for i in range(len(words) - reach)}
        elif words:
            out = {" ".join(words)}
        elif text:
            out = {text}
    return frozenset(out)


def jaccard(a: frozenset, b: frozenset, threshold: float = 0.0) -> float:
    """Likeness of two sets, 0.0 if it is below the threshold; told from the sizes alone where these rule it out."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    low, high = len(small), len(large)
    if high == 0:
        return 1.0
    if low < threshold * high:
        return 0.0
    both = len(small & large)
    likeness = both / (low + high - both)
    return likeness if likeness >= threshold else 0.0


class Ranges:
    """Ranges of set sizes for a threshold, and the likeness of sets by them: only sets of one range or neighbours are compared."""

    def __init__(self, threshold: float):
        self.threshold, self.starts = threshold, [0, 1]

    def of(self, size: int) -> int:
        while self.starts[-1] <= size:
            self.starts.append(_next_range(self.starts[-1], self.threshold))
        return bisect.bisect_right(self.starts, size) - 1

    def likeness(self, a: frozenset, b: frozenset) -> float:
        if self.threshold > 0 and abs(self.of(len(a)) - self.of(len(b))) > 1:
            return 0.0
        return jaccard(a, b, self.threshold)


def digest(sigs: frozenset[str]) -> str:
    """A set as a string: its size and a hash of its sorted signatures."""
    return f"{len(sigs)}:{hashlib.blake2b(chr(0).join(sorted(sigs)).encode('utf-8', 'surrogatepass'), digest_size=16).hexdigest()}"


def signature_column(text: Column, **chain: int) -> Column:
    """signatures() of a text column as an array of distinct 64-bit hashes."""

    @F.pandas_udf("array<string>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([sorted(signatures(t, **chain)) for t in batch], dtype=object)

    return F.array_distinct(F.transform(of(text), lambda s: F.xxhash64(s)))


def edited(text: str, following: str) -> str:
    """The text, its last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


class _Order:
    """Parts of the rows in order of (id, hash of text), and the first row of each part."""

    def __init__(self, bounds: list[tuple]):
        self.bounds = bounds
        self.first: dict[tuple, int] = {}

    def part(self, key: tuple) -> int:
        return bisect.bisect_right(self.bounds, key)


def _key(i: int | str | None, h: int) -> tuple:
    return (0, 0, h) if i is None else (1, i, h)


def _after(i: int | str) -> tuple:
    """The first key after all of an id."""
    return (1, i + 1 if isinstance(i, int) else i + "\0", -(1 << 63))


def with_next(df: DataFrame, id_col: str = "doc_id", text: str = "text", part_size: int | None = None) -> tuple[DataFrame, _Order]:
    """Rows (id, h, text, copies, part, own) in parts of the order by id, and the order. Each part also holds the row after its last, not its own.

    One shuffle of the texts. Bounds of the parts come from percentiles of the ids (from a bounded sample of those that are no numbers); an id with more rows than fit a part
    is split by the hash, and its fully repeated rows become one with a number of copies, counted before the shuffle.
    """
    whole = isinstance(df.schema[id_col].dataType, _WHOLE)
    rows = df.select(F.col(id_col).cast("long" if whole else "string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("h"), "text", F.lit(1).cast("long").alias("copies"))
    total, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text") + 32), F.lit(0))).first()
    parts = max(1, -(-size // (part_size or part_bytes(size))), min(total, df.sparkSession.sparkContext.defaultParallelism))
    shares = [k / parts for k in range(1, parts)]
    bounds: set[tuple] = set()
    if shares and not whole:
        sample = sorted(r["id"] for r in rows.where("id is not null").orderBy(F.xxhash64("id", "h")).select("id").limit(min(ID_SAMPLE, 100 * parts)).collect())
        bounds |= {(1, sample[int(x * len(sample))], -(1 << 63)) for x in shares if sample}
    elif shares:
        at = rows.agg(F.percentile_approx("id", F.array(*map(F.lit, shares)) if parts < 400 else F.from_json(F.lit(str(shares)), "array<double>"), max(10_000, 20 * parts))).first()[0]
        bounds |= {(1, int(i), -(1 << 63)) for i in at or []}
    most = max(64, total // parts)
    crowded = [(r["id"], r["n"]) for r in rows.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > most).collect()]  # at most `parts` ids
    if crowded:
        for i, n in crowded:
            pieces = -(-n // most)
            low = _key(i, 0)[:2]
            bounds |= {(*low, -(1 << 63) + k * ((1 << 64) // pieces)) for k in range(pieces)} | {_after(i) if i is not None else (1, -(1 << 63) if whole else "", -(1 << 63))}
        ids = [i for i, _ in crowded if i is not None]
        hot = F.coalesce(F.col("id").isin(ids), F.lit(False)) | (F.col("id").isNull() if any(i is None for i, _ in crowded) else F.lit(False))
        rows = rows.where(~hot).unionByName(rows.where(hot).groupBy("id", "h", "text").agg(F.sum("copies").alias("copies")))
    order = _Order(sorted(bounds))
    parts = len(order.bounds) + 1

    key = (F.col("id").isNotNull().cast("int"), F.coalesce("id", F.lit(0).cast("long") if whole else F.lit("")), F.col("h"))

    @F.pandas_udf("int")
    def part_of(known: pd.Series, i: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([order.part(_key(i if known else None, h)) for known, i, h in zip(known.tolist(), i.tolist(), h.tolist(), strict=True)], dtype="int32")

    firsts = rows.select("id", "h", part_of(*key).alias("part")).groupBy("part").agg(F.min(F.struct("id", "h")).alias("first")).collect()
    found = sorted((r["part"], _key(r["first"]["id"], r["first"]["h"])) for r in firsts)
    order.first = {key: found[k - 1][0] for k, (_, key) in enumerate(found)}  # k - 1 = -1: after the last row comes the first

    @F.pandas_udf("array<int>")
    def parts_of(known: pd.Series, i: pd.Series, h: pd.Series) -> pd.Series:
        keys = (_key(i if known else None, h) for known, i, h in zip(known.tolist(), i.tolist(), h.tolist(), strict=True))
        return pd.Series([[order.part(k)] + ([order.first[k]] if k in order.first else []) for k in keys], dtype=object)

    sent = rows.select("*", F.posexplode(parts_of(*key)).alias("pos", "part")).select("id", "h", "text", "copies", "part", (F.col("pos") == 0).alias("own"))
    return sent.repartitionById(parts, F.col("part")), order


def fingerprints(df: DataFrame, id_col: str = "doc_id", text: str = "text", part_size: int | None = None, threshold: float = LEAST) -> DataFrame:
    """One row for each row of df: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures.

    The edited text takes its end from the next row in the order of ids (after the last: the first).
    """
    sent, _ = with_next(df, id_col, text, part_size)
    kind = df.schema[id_col].dataType
    schema = f"`{id_col}` {dict(sent.dtypes)['id']}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long, copies long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list[tuple]] = {}
        likeness = Ranges(threshold).likeness
        for x in batches:
            for i, h, t, n, part, own in zip(*(c.to_pylist() for c in x.columns), strict=True):
                rows.setdefault(part, []).append((not own, _key(i, h), i, t, n))
        for part in sorted(rows):
            held = sorted(rows.pop(part), key=lambda r: r[:2])
            out, sigs = [], None
            for k, (foreign, _, i, t, n) in enumerate(held):
                if foreign:
                    break
                mine = sigs if sigs is not None else signatures(t)
                sigs = signatures(held[k + 1][3])
                steps = [(t, mine, n - 1)] if n > 1 else []
                for following, theirs, copies in [*steps, (held[k + 1][3], sigs, 1)]:
                    e = edited(t, following)
                    es = signatures(e)
                    out.append((i, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), digest(mine), digest(es), likeness(mine, es), likeness(mine, theirs), len(mine), copies))
                if len(out) >= 2000:
                    yield _rows(out, id_col)
                    out = []
            if out:
                yield _rows(out, id_col)

    done = sent.mapInArrow(run, schema)
    return done.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies").withColumn(id_col, F.col(id_col).cast(kind))


def _rows(out: list[tuple], id_col: str) -> pa.RecordBatch:
    kinds = (pa.string() if any(isinstance(r[0], str) for r in out) else pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
    names = (id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_signatures", "copies")
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names=list(names))


def _next_range(low: int, threshold: float) -> int:
    return max(low + 1, int(np.ceil(low / threshold)) + 1)


def size_ranges(longest: int, threshold: float) -> list[int]:
    """First sizes of the ranges: sets of sizes p and q with p/q >= threshold lie in one range or neighbours."""
    out, low = [0, 1], 1
    while low <= longest:
        low = _next_range(low, threshold)
        out.append(low)
    return out


def similar_pairs(df: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members has (id, set_id) for each row; pairs has (a, b, likeness) for distinct sets a < b with Jaccard >= threshold.

    Rows of equal sets are one class before any comparison. Each set is indexed under its rarest signatures only, as many
    as leave no similar set unseen, in its range of sizes and the next; candidates are verified on whole sets.
    Empty sets form one class that pairs with none.
    """
    sets = df.select(F.col(id_col).alias("id"), signature_column(F.col(text)).alias("sigs")).withColumn("sigs", F.array_sort("sigs"))
    members = written(sets, "sets")
    marked = members.withColumn("set_id", F.xxhash64("sigs"))
    classes = written(marked.where(F.size("sigs") > 0).groupBy("set_id").agg(F.first("sigs").alias("sigs")), "classes")
    longest = classes.agg(F.coalesce(F.max(F.size("sigs")), F.lit(0))).first()[0]
    starts = size_ranges(longest, threshold)
    size = F.size("sigs")
    part = sum((F.when(size >= s, 1).otherwise(0) for s in starts[1:]), F.lit(0)) if len(starts) < 200 else F.size(F.filter(F.from_json(F.lit(str(starts[1:])), "array<int>"), lambda s: s <= size))
    each = classes.select("set_id", size.alias("n"), part.alias("part"), F.explode("sigs").alias("sig"))
    common = each.groupBy("sig").agg(F.count("*").alias("f"))
    rare = each.join(common, "sig").withColumn("k", F.row_number().over(Window.partitionBy("set_id").orderBy("f", "sig"))).where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    left = rare.select("sig", "part", F.col("set_id").alias("a"), F.col("n").alias("n_a"))
    right = rare.select("sig", F.explode(F.array("part", F.col("part") + 1)).alias("part"), F.col("set_id").alias("b"), F.col("n").alias("n_b"))
    near = (F.col("n_b") <= F.col("n_a")) & (F.col("n_b") >= F.col("n_a") * threshold - 1e-9) & (F.col("a") != F.col("b"))
    found = left.join(right, ["sig", "part"]).where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    of = lambda x: classes.select(F.col("set_id").alias(x), F.col("sigs").alias(f"s_{x}"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    likeness = both / (F.size("s_a") + F.size("s_b") - both)
    pairs = found.join(of("a"), "a").join(of("b"), "b").select("a", "b", likeness.alias("likeness")).where(F.col("likeness") >= threshold)
    return marked.select(F.col("id").alias(id_col), "set_id"), pairs
