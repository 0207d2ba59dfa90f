"""BM25 keyword ranking: over raw text in one scan, and over a positional inverted index.

score = sum over phrases of idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * |d| / avg |d|)), idf = ln((N - df + 0.5) / (df + 0.5)),
1e-6 if that is not above 0; tf sums the columns' weights. N, df and the average are of the whole corpus, whatever filter
restricts the hits. A phrase that a query repeats counts each time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.stemming import accents, analyzed, stems
from millrace.functions.text import K1, WORDS, B, term_count, terms
from millrace.session import written


#: Words of which a task makes postings at once.
TOKENS = 1 << 18
#: Repeated ids that go to all tasks; more are joined by a shuffle.
MOST_REPEATED = 100_000


@dataclass(frozen=True)
class Corpus:
    """Numbers of a corpus: rows, tokens, and rows with each phrase."""

    rows: int
    tokens: int
    df: Mapping[str, int]

    @property
    def mean(self) -> float:
        return self.tokens / self.rows if self.rows else 0.0

    def idf(self, phrase: str) -> float:
        n = self.df.get(phrase, 0)
        value = math.log((self.rows - n + 0.5) / (n + 0.5))
        return value if value > 0 else 1e-6


def weighed(tf: Column, length: Column, idf: float, mean: float) -> Column:
    """One phrase's part of a score."""
    return F.lit(idf) * tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / F.lit(mean or 1.0)))


def counted(df: DataFrame, text: str, words: Sequence[str]) -> DataFrame:
    """df with __dl (terms of the text) and __tf0, __tf1, ... (occurrences of each word): a projection, no shuffle."""
    tokens = df.withColumn("__tokens", terms(F.col(text)))
    return tokens.withColumns({"__dl": F.size("__tokens"), **{f"__tf{k}": term_count(F.col("__tokens"), w) for k, w in enumerate(words)}}).drop("__tokens")


def measured(df: DataFrame, text: str, words: Sequence[str]) -> DataFrame:
    """df without its text, with __dl and the counts of the distinct words, as a written table: texts are read once, whatever is asked of the counts."""
    return written(counted(df, text, list(dict.fromkeys(words))).drop(text), "counts")


def corpus_of(counts: DataFrame, words: Sequence[str]) -> Corpus:
    """One aggregation over measured() rows; one row comes back."""
    distinct = list(dict.fromkeys(words))
    row = counts.agg(F.count("*"), F.sum("__dl"), *(F.count_if(F.col(f"__tf{k}") > 0) for k in range(len(distinct)))).first()
    return Corpus(row[0], row[1] or 0, dict(zip(distinct, row[2:], strict=True)))


def scanned(df: DataFrame, text: str, words: Sequence[str], mode: str = "or", where: Column | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Rows of df, without the text, that hold one ("or") or all ("and") of the words, with a column bm25. `where` restricts the hits, not the corpus. counts: measured() of df and words, to be shared by several lists."""
    counts = measured(df, text, words) if counts is None else counts
    corpus, number = corpus_of(counts, words), {w: k for k, w in enumerate(dict.fromkeys(words))}
    hits = counts if where is None else counts.where(where)
    tests = [F.col(f"__tf{k}") > 0 for k in number.values()]
    hits = hits.where(reduce((lambda a, b: a & b) if mode == "and" else (lambda a, b: a | b), tests))
    score = reduce(lambda a, b: a + b, (weighed(F.col(f"__tf{number[w]}"), F.col("__dl"), corpus.idf(w), corpus.mean) for w in words))
    return hits.withColumn("bm25", score).drop("__dl", *(f"__tf{k}" for k in number.values()))


def frequencies(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(term, df, tf) of all terms: documents that hold it, occurrences. Rows of one id, null too, are one document.

    A row's distinct terms and its terms are counted by term alone, so that what is shuffled follows the vocabulary; only rows whose id is repeated are grouped by term and id.
    """
    ids = df.groupBy(F.col(id_col).alias("__id")).agg(F.count("*").alias("__n")).where("__n > 1").select("__id")
    repeated = ids.count()
    rows = df.select(F.col(id_col).alias("__doc"), terms(F.col(text)).alias("__words"))
    single, many = rows, None
    if repeated:
        ids = F.broadcast(ids) if repeated <= MOST_REPEATED else ids
        same = F.col("__doc").eqNullSafe(F.col("__id"))
        many = rows.join(ids, same, "left_semi").select("__doc", F.explode("__words").alias("term")).groupBy("term", "__doc").agg(F.count("*").alias("__n"))
        single = rows.join(ids, same, "left_anti")
    both = single.select("__words", F.array_distinct("__words").alias("__distinct"))
    each = both.select(F.size("__distinct").alias("__d"), F.posexplode(F.concat("__distinct", "__words")).alias("__at", "term"))
    first = F.col("__at") < F.col("__d")  # distinct terms come first
    each = each.select("term", first.cast("long").alias("df"), (~first).cast("long").alias("tf"))
    if many is not None:
        each = each.unionByName(many.groupBy("term").agg(F.count("*").alias("df"), F.sum("__n").alias("tf")))
    return each.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def index_terms(text: Column) -> Column:
    """Words of a text as the index has them before they are stemmed: lower case, without accents."""
    low = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    letters, plain = accents()
    return F.regexp_extract_all(F.when(low.rlike(r"[^\x00-\x7F]"), F.translate(low, letters, plain)).otherwise(low), F.lit(WORDS), 0)


def postings(df: DataFrame, id_col: str, fields: Sequence[str], stemmed: bool = True, carry: Sequence[str] = ()) -> DataFrame:
    """Rows (term, id, field, tf, positions, dl, carry): the inverted index. Positions run over all fields of a row, with a gap between; dl: terms of the row.

    Words are found by Spark; distinct words of a batch are stemmed once, and occurrences grouped as arrays of numbers.
    """
    rows = df.select(F.col(id_col).alias("id"), *carry, *(index_terms(F.col(f)).alias(f"__{k}") for k, f in enumerate(fields)))
    keys = [rows.schema[c] for c in ("id", *carry)]
    schema = T.StructType([T.StructField("term", T.StringType()), keys[0], T.StructField("field", T.IntegerType()), T.StructField("tf", T.IntegerType()), T.StructField("positions", T.ArrayType(T.IntegerType())), T.StructField("dl", T.LongType()), *keys[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return posted(batches, len(fields), stemmed, schema.names)

    return rows.mapInArrow(run, schema)


def posted(batches: Iterator[pa.RecordBatch], fields: int, stemmed: bool, names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Postings, with columns of the names, of batches (id, carry, an array of words for each field), in parts of whole rows that have TOKENS words together; a longer row is a part by itself."""
    for whole in batches:
        keys = whole.num_columns - fields
        n = np.array([whole.column(keys + f).value_lengths().to_numpy() for f in range(fields)]).sum(axis=0)
        ends, at, before = np.cumsum(n), 0, 0
        while at < len(ends):
            stop = max(at + 1, int(np.searchsorted(ends, before + TOKENS, "right")))
            if ends[stop - 1] > before:
                yield _posted(whole.slice(at, stop - at), fields, stemmed, names)
            at, before = stop, int(ends[stop - 1])


def _posted(batch: pa.RecordBatch, fields: int, stemmed: bool, names: Sequence[str]) -> pa.RecordBatch:
    keys = batch.num_columns - fields
    parts = [batch.column(keys + f) for f in range(fields)]
    counts = np.array([p.value_lengths().to_numpy() for p in parts])  # by field and row
    dl = counts.sum(axis=0)
    words = pa.concat_arrays([p.flatten() for p in parts]).dictionary_encode()
    distinct = words.dictionary.to_pylist()
    terms_, code = np.unique(np.array(stems(distinct) if stemmed else distinct, object), return_inverse=True)
    code = code[words.indices.to_numpy()]
    row = np.concatenate([np.repeat(np.arange(batch.num_rows), c) for c in counts])
    field = np.repeat(np.arange(fields), counts.sum(axis=1))
    before = np.cumsum(counts, axis=0) - counts + np.arange(fields)[:, None]  # terms of earlier fields and gaps
    inside = np.concatenate([np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) for c in counts])
    position = before[field, row] + inside
    order = np.lexsort((position, field, code, row))
    row, field, code, position = row[order], field[order], code[order], position[order]
    starts = np.flatnonzero(np.concatenate(([True], (np.diff(row) != 0) | (np.diff(code) != 0) | (np.diff(field) != 0))))
    at, ends = pa.array(row[starts]), np.append(starts, len(row))
    columns = [pa.array(terms_, pa.string()).take(pa.array(code[starts])), batch.column(0).take(at), pa.array(field[starts], pa.int32()), pa.array(np.diff(ends), pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(position, pa.int32())), pa.array(dl[row[starts]], pa.int64())]
    return pa.RecordBatch.from_arrays(columns + [batch.column(k).take(at) for k in range(1, keys)], names=names)


def clustered(index: DataFrame) -> DataFrame:
    """An index in the order that searches read: ranges of (term, id), so that a term of any number of rows is spread over tasks and files, and files are told apart by their terms."""
    return index.repartitionByRange("term", "id").sortWithinPartitions("term", "id")


def lengths(index: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """(keys, dl): terms of each row that has any, over all fields."""
    return index.groupBy(*keys).agg(F.first("dl").alias("dl"))


def _back(shift: int) -> Callable[[Column], Column]:
    return lambda p: p - F.lit(shift)


def phrase_hits(index: DataFrame, phrase: Sequence[str], number: int, keys: Sequence[str] = ("id",)) -> DataFrame:
    """(keys, field, dl, tf, phrase) of the rows of an index that hold the terms of a phrase one after another."""
    on = [*keys, "field"]
    first = index.where(F.col("term") == phrase[0]).select(*on, "dl", "positions")
    for shift, term in enumerate(phrase[1:], 1):
        following = index.where(F.col("term") == term).select(*on, F.col("positions").alias("__next"))
        met = F.array_intersect("positions", F.transform("__next", _back(shift)))
        first = first.join(following, on).select(*on, "dl", met.alias("positions")).where(F.size("positions") > 0)
    return first.select(*on, "dl", F.size("positions").alias("tf"), F.lit(number).alias("phrase"))


@dataclass(frozen=True)
class Hits:
    """Phrase hits of a query, read once and used by several legs: rows (keys, phrase, tf, dl), and what scoring needs."""

    rows: DataFrame
    corpus: Corpus
    times: tuple[int, ...]  # how often the query has each phrase

    def scored(self, keys: Sequence[str], mode: str) -> DataFrame:
        """(keys, bm25) of the rows that hold one phrase ("or") or all ("and")."""
        number = F.col("phrase")
        value = F.element_at(F.array(*(F.lit(self.corpus.idf(str(k)) * n) for k, n in enumerate(self.times))), number + 1)
        part = value * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(self.corpus.mean or 1.0)))
        out = self.rows.groupBy(*keys).agg(F.sum(part).alias("bm25"), F.count("*").alias("__n"))
        if mode == "and":
            out = out.where(F.col("__n") == len(self.times))
        return out.drop("__n")


def find(index: DataFrame, rows: int, tokens: int, phrases: Sequence[str], weights: Sequence[float] | None = None, stemmed: bool = True, keys: Sequence[str] = ("id",)) -> Hits | None:
    """Hits of the phrases in an index; None if they have no terms. Only the query's terms are read: the filter on term reaches the Parquet scan.

    rows, tokens: of the live rows, to which the index must be restricted. weights: of the fields; a hit in a field of weight 0
    matches but adds nothing. Hits carry their rows' lengths, so that nothing is joined.
    """
    parsed = [tuple(p) for p in (analyzed(x, stemmed) for x in phrases) if p]
    if not parsed:
        return None
    distinct = list(dict.fromkeys(parsed))
    wanted = index.where(F.col("term").isin(*sorted({t for p in distinct for t in p})))
    single = [(k, p[0]) for k, p in enumerate(distinct) if len(p) == 1]
    hits = None
    if single:  # one pass for all phrases of one term
        number = F.create_map(*(x for k, t in single for x in (F.lit(t), F.lit(k))))
        hits = wanted.where(F.col("term").isin(*(t for _, t in single))).select(*keys, "field", "dl", "tf", number[F.col("term")].alias("phrase"))
    for k, p in enumerate(distinct):
        if len(p) > 1:
            more = phrase_hits(wanted, p, k, keys)
            hits = more if hits is None else hits.unionByName(more)
    weight = F.lit(1.0) if weights is None else F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("field") + 1)
    per = hits.groupBy(*keys, "phrase").agg(F.sum(F.col("tf") * weight).alias("tf"), F.first("dl").alias("dl"))
    found = {str(r["phrase"]): r["n"] for r in per.groupBy("phrase").agg(F.count("*").alias("n")).collect()}  # a row for each phrase of the query
    return Hits(per, Corpus(rows, tokens, found), tuple(parsed.count(p) for p in distinct))


def search(index: DataFrame, rows: int, tokens: int, phrases: Sequence[str], mode: str = "or", weights: Sequence[float] | None = None, stemmed: bool = True) -> DataFrame:
    """(id, bm25) of the rows that match."""
    hits = find(index, rows, tokens, phrases, weights, stemmed)
    if hits is None:
        return index.sparkSession.createDataFrame([], f"id {dict(index.dtypes)['id']}, bm25 double")
    return hits.scored(["id"], mode)
