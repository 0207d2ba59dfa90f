"""The engine's operators as queries over the driver's tables, each with the same in DuckDB's SQL where SQL can say it.

Scores are rounded to six digits on both sides. Lists of fixed length are the feature there (top-k search).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import identifiers as I
from millrace.functions import text as X
from millrace.functions import vectors as V
from millrace.operators import bm25, embed, filters, fusion, knn, metrics, rerank
from millrace.operators.chunking import chunked, code_chunker, markdown_chunker
from millrace.plans.engine import SearchEngine
from millrace.session import written
from millrace.sources.store import upserted, without

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
OR_TERMS, AND_TERMS, COMMON = ("that", "with", "und"), ("that", "with"), ("the", "und")
SNIPPET_QUERY = "that with the thing"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# -- filters


def _filter(name: str, table: str, columns: list[str], where: dict, sql: str, source: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _labelled(spark, sf_dir) if table == "labelled" else _t(spark, sf_dir, table)
        return filters.filtered(df, where, filters.json("props") if table == "events" else None).select(*columns)

    base = "(SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)" if table == "labelled" else table
    query(name, f"SELECT {', '.join(columns)} FROM {base} WHERE {sql}")(run)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", "lang").join(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")


_DOC = ["doc_id", "lang", "source", "n_chars"]
_filter("filter_exact", "documents", _DOC, {"lang": "fr"}, "lang = 'fr'")
_filter("filter_eq", "documents", _DOC, {"source": {"$eq": "src3"}}, "source = 'src3'")
_filter("filter_ne", "labelled", ["doc_id", "lang", "quality"], {"quality": {"$ne": 1}}, "quality <> 1")
_filter("filter_gt", "documents", _DOC, {"n_chars": {"$gt": 2000}}, "n_chars > 2000")
_filter("filter_gte", "documents", _DOC, {"n_chars": {"$gte": 999}}, "n_chars >= 999")
_filter("filter_lt", "documents", _DOC, {"n_chars": {"$lt": 500}}, "n_chars < 500")
_filter("filter_lte", "part", ["p_partkey", "p_size"], {"p_size": {"$lte": 10}}, "p_size <= 10")
_filter("filter_in", "documents", _DOC, {"lang": {"$in": ["de", "es"]}}, "lang IN ('de', 'es')")
_filter("filter_in_empty", "documents", _DOC, {"lang": {"$in": []}}, "1 = 0")
_filter("filter_nin", "labelled", ["doc_id", "lang", "quality"], {"quality": {"$nin": [1]}}, "quality NOT IN (1)")
_filter("filter_nin_empty", "documents", _DOC, {"lang": {"$nin": []}}, "1 = 1")
_filter("filter_prefix", "pages", ["page_id", "url"], {"url": {"$prefix": "https://"}}, "starts_with(url, 'https://')")
_filter("filter_contains", "pages", ["page_id", "url"], {"url": {"$contains": "example.org"}}, "contains(url, 'example.org')")
_filter("filter_exists", "labelled", ["doc_id", "lang", "quality"], {"quality": {"$exists": False}}, "quality IS NULL")
_filter("filter_and", "documents", _DOC, {"lang": "en", "n_chars": {"$gte": 500, "$lt": 3000}, "source": {"$prefix": "src1"}}, "lang = 'en' AND n_chars >= 500 AND n_chars < 3000 AND starts_with(source, 'src1')")
_filter("filter_json_path", "events", ["event_id", "event_type"], {"k": {"$gt": 50}}, "CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50")

# -- words

_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"


def _bm25_sql(words: tuple[str, ...], mode: str = "or", where: str = "TRUE", tail: str = "ORDER BY round(bm25, 6) DESC, doc_id LIMIT 10", pick: str = "doc_id, round(bm25, 6) AS bm25") -> str:
    return f"""
    WITH t AS (SELECT doc_id, lang, {_TOK} AS tok FROM documents),
    c AS (SELECT count(*) AS n, sum(len(tok)) / count(*) AS mean FROM t),
    q AS (SELECT unnest({list(words)!r}) AS term),
    f AS (SELECT t.doc_id, t.lang, q.term, len(t.tok) AS dl, len(list_filter(t.tok, lambda x: x = q.term)) AS tf FROM t CROSS JOIN q),
    h AS (SELECT * FROM f WHERE tf > 0),
    d AS (SELECT term, count(*) AS df FROM h GROUP BY term),
    i AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM d CROSS JOIN c),
    s AS (SELECT h.doc_id, any_value(h.lang) AS lang, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS bm25, count(*) AS hits FROM h JOIN i USING (term) CROSS JOIN c GROUP BY h.doc_id)
    SELECT {pick} FROM s WHERE {where}{f' AND hits = {len(words)}' if mode == 'and' else ''} {tail}"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", "lang", "text")


def _ranked_words(spark: SparkSession, sf_dir: str, words: tuple[str, ...], mode: str = "or", where: Column | None = None, counts: DataFrame | None = None) -> DataFrame:
    return bm25.scanned(_texts(spark, sf_dir), "text", words, mode, where, counts).select("doc_id", "lang", "bm25")


def _best(df: DataFrame, k: int = 10) -> DataFrame:
    return knn.nearest(df, k, [F.round("bm25", 6).desc(), "doc_id"]).select("doc_id", F.round("bm25", 6).alias("bm25"))


@query("bm25_or_topk", _bm25_sql(OR_TERMS))
def bm25_or_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(_ranked_words(spark, sf_dir, OR_TERMS))


@query("bm25_and_topk", _bm25_sql(AND_TERMS, "and"))
def bm25_and_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(_ranked_words(spark, sf_dir, AND_TERMS, "and"))


@query("bm25_common_topk", _bm25_sql(COMMON))
def bm25_common_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(_ranked_words(spark, sf_dir, COMMON))


@query("bm25_filtered", _bm25_sql(OR_TERMS, where="lang = 'en'"))
def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(_ranked_words(spark, sf_dir, OR_TERMS, where=F.col("lang") == "en"))


@query("bm25_score_norm", _bm25_sql(("und",), pick="doc_id, round(bm25, 6) AS bm25, round(1 / (1 + abs(bm25)), 6) AS score"))
def bm25_score_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = knn.nearest(_ranked_words(spark, sf_dir, ("und",)), 10, [F.round("bm25", 6).desc(), "doc_id"])
    return best.select("doc_id", F.round("bm25", 6).alias("bm25"), F.round(V.keyword_score(F.col("bm25")), 6).alias("score"))


@query("term_tf", f"SELECT doc_id, len(list_filter({_TOK}, lambda x: x = 'that')) AS tf FROM documents")
def term_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", X.term_count(X.terms(F.col("text")), "that").cast("long").alias("tf"))


@query("term_df", f"SELECT term, count(*) AS df, sum(tf) AS tf FROM (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY ALL) GROUP BY term".replace("sum(tf)", "sum(tf)::BIGINT"))
def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.frequencies(_t(spark, sf_dir, "documents"), "doc_id", "text")


@query("corpus_stats", f"SELECT count(*) AS n_docs, sum(len({_TOK}))::BIGINT AS n_tokens, round(avg(len({_TOK})), 6) AS mean_tokens FROM documents")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(X.terms(F.col("text")))
    return _t(spark, sf_dir, "documents").agg(F.count("*").alias("n_docs"), F.sum(n).alias("n_tokens"), F.round(F.avg(n), 6).alias("mean_tokens"))


_NAME = "lang || upper(substr(source, 1, 1)) || substr(source, 2)"
_SPACED = f"regexp_replace(regexp_replace({_NAME}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]{{1,}})([A-Z][a-z])', '\\1 \\2', 'g')"


def _name() -> Column:
    return F.concat("lang", F.upper(F.substring("source", 1, 1)), F.expr("substr(source, 2)"))


@query("code_tokenize", f"SELECT doc_id, CASE WHEN {_SPACED} = {_NAME} THEN {_NAME} ELSE {_SPACED} || ' ' || {_NAME} END AS expanded FROM documents")
def code_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", I.expanded(_name()).alias("expanded"))


@query("code_ident_flag", "SELECT page_id, regexp_matches(url, '[a-z][A-Z]|[A-Z]{2}[a-z]|[_.]') AS is_identifier, regexp_matches(split_part(url, '://', 1), '[a-z][A-Z]|[A-Z]{2}[a-z]|[_.]') AS scheme_is FROM pages")
def code_ident_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", I.identifier_flag(F.col("url")).alias("is_identifier"), I.identifier_flag(F.split_part("url", F.lit("://"), F.lit(1))).alias("scheme_is"))


_FILE = "source || CASE lang WHEN 'en' THEN '.ts' WHEN 'fr' THEN '.JSX' WHEN 'de' THEN '.md' ELSE '' END"


@query("content_type_route", f"SELECT doc_id, CASE WHEN lower(split_part({_FILE}, '.', -1)) IN ('cjs','cts','js','jsx','mjs','mts','ts','tsx') THEN 'code' ELSE 'markdown' END AS kind FROM documents")
def content_type_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.when(F.col("lang") == "en", ".ts").when(F.col("lang") == "fr", ".JSX").when(F.col("lang") == "de", ".md").otherwise("")
    return _t(spark, sf_dir, "documents").select("doc_id", I.content_type_column(F.concat("source", ending)).alias("kind"))


@query("text_sha256", "SELECT doc_id, sha256(text) AS hash FROM documents")
def text_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", X.content_hash(F.col("text")).alias("hash"))


# -- vectors

_SCALED = "(SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x * (vec_id % 3 + 1)) AS v FROM embeddings)"
_QUERY = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    factor = F.col("vec_id") % 3 + 1
    return _t(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform(V.doubles(F.col("embedding")), lambda x: x * factor).alias("v"))


def _asked(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(_t(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"])


def _near(df: DataFrame, query_: list[float], metric: str, k: int = 10) -> DataFrame:
    away = knn.with_distance(df.where("vec_id <> 0"), "v", query_, metric)
    return knn.nearest(away, k, [F.round("distance", 6), "vec_id"])


def _near_sql(distance: str, score: str, where: str = "TRUE", k: int = 10) -> str:
    return f"SELECT vec_id, round(distance, 6) AS distance, round({score}, 6) AS score FROM (SELECT vec_id, label, {distance} AS distance FROM {_SCALED} CROSS JOIN {_QUERY} WHERE vec_id <> 0) WHERE {where} ORDER BY round(distance, 6), vec_id LIMIT {k}"


def _vec(name: str, metric: str, score: Callable[[Column], Column], distance_sql: str, score_sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        best = _near(_scaled(spark, sf_dir), _asked(spark, sf_dir), metric)
        return best.select("vec_id", F.round("distance", 6).alias("distance"), F.round(score(F.col("distance")), 6).alias("score"))

    query(name, _near_sql(distance_sql, score_sql))(run)


_COS = "1 - list_cosine_similarity(v, q)"
_vec("vec_l2_topk", "l2", V.l2_score, "list_distance(v, q)", "1 / (1 + distance)")
_vec("vec_cosine_topk", "cosine", V.cosine_score, _COS, "greatest(0.0, 1 - distance)")
_vec("vec_euclid_pg_score", "l2", V.cosine_score, "list_distance(v, q)", "greatest(0.0, 1 - distance)")
_vec("vec_ip_topk", "ip", V.ip_score, "-list_inner_product(v, q)", "least(1.0, greatest(0.0, (distance + 1) / 2))")


@query("vec_filtered", _near_sql("list_distance(v, q)", "1 / (1 + distance)", "label = 3"))
def vec_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _near(filters.filtered(_scaled(spark, sf_dir), {"label": 3}), _asked(spark, sf_dir), "l2")
    return best.select("vec_id", F.round("distance", 6).alias("distance"), F.round(V.l2_score(F.col("distance")), 6).alias("score"))


@query("vec_postfilter_overfetch", f"SELECT vec_id, distance FROM (SELECT vec_id, label, round({_COS}, 6) AS distance FROM {_SCALED} CROSS JOIN {_QUERY} WHERE vec_id <> 0 ORDER BY distance, vec_id LIMIT 40) WHERE label = 3 ORDER BY distance, vec_id LIMIT 10")
def vec_postfilter_overfetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    fetched = _near(_scaled(spark, sf_dir), _asked(spark, sf_dir), "cosine", 40)
    kept = filters.filtered(fetched, {"label": 3})
    return knn.nearest(kept, 10, [F.round("distance", 6), "vec_id"]).select("vec_id", F.round("distance", 6).alias("distance"))


@query("vec_dim_check", "SELECT vec_id, len(embedding)::BIGINT AS n FROM embeddings")
def vec_dim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.size(V.same_width(F.col("embedding"), 64)).cast("long").alias("n"))


@query("vec_normalize", f"SELECT vec_id, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first, round(list_sum(list_transform(v, lambda x: abs(x))) / sqrt(list_inner_product(v, v)), 5) AS abs_sum FROM {_SCALED}")
def vec_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = _scaled(spark, sf_dir).select("vec_id", V.normalized(F.col("v")).alias("u"))
    return unit.select("vec_id", F.round(F.element_at("u", 1), 6).alias("first"), F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + F.abs(x)), 5).alias("abs_sum"))


QUERY_BLOCK = 4_096


@query("vec_ann_recall")
def vec_ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of a search of inverted cells: every row whose id is divisible by 50 asks for its ten nearest, in blocks of queries."""
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    cells = knn.Cells.fit(rows, "vec_id", "embedding", metric="cosine")
    listed = written(cells.assigned(rows, "embedding"), "cells")
    asked = iter(rows.where("vec_id % 50 = 0 and embedding is not null").toLocalIterator())
    exact = found = None
    while block := list(islice(asked, QUERY_BLOCK)):
        ids, q = np.array([r["vec_id"] for r in block]), np.array([r["embedding"] for r in block], float)
        one, two = (knn.nearest_to_each(listed, "vec_id", "embedding", ids, q, 10, "cosine", c).select("query", "id") for c in (None, cells))
        exact, found = (one, two) if exact is None else (exact.unionByName(one), found.unionByName(two))
    if exact is None:
        return spark.createDataFrame([], "queries long, neighbours long, recall double")
    both = exact.join(found.withColumn("hit", F.lit(1.0)), ["query", "id"], "left")
    return both.agg(F.count_distinct("query").alias("queries"), F.count("*").alias("neighbours"), F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("recall"))


# -- fusion

_WORD_LIST = lambda words, mode, k, n, w, by="": f"SELECT doc_id AS id, {n} AS list, row_number() OVER (ORDER BY round(bm25, 6) DESC, doc_id) AS rank, {w} AS weight FROM ({_bm25_sql(words, mode, tail=f'ORDER BY round(bm25, 6) DESC, doc_id LIMIT {k}', pick='doc_id, bm25')})"
_VEC_LIST = lambda k, n, w: f"SELECT vec_id AS id, {n} AS list, row_number() OVER (ORDER BY round(distance, 6), vec_id) AS rank, {w} AS weight FROM (SELECT vec_id, {_COS} AS distance FROM {_SCALED} CROSS JOIN {_QUERY} WHERE vec_id <> 0 ORDER BY round(distance, 6), vec_id LIMIT {k})"


def _fused_sql(lists: list[str], k: int) -> str:
    rows = " UNION ALL ".join(f"SELECT * FROM ({x})" for x in lists)
    return f"SELECT id, round(sum(weight / (60.0 + rank)), 9) AS score FROM ({rows}) GROUP BY id ORDER BY round(sum(weight / (60.0 + rank)), 12) DESC, min(list * 1000000 + rank), id LIMIT {k}"


def _words_list(spark: SparkSession, sf_dir: str, words: tuple[str, ...], mode: str, k: int, number: int, weight: float = 1.0, counts: DataFrame | None = None) -> DataFrame:
    rows = _ranked_words(spark, sf_dir, words, mode, counts=counts).withColumnRenamed("doc_id", "id")
    return fusion.ranked(rows, [F.round("bm25", 6).desc(), F.col("id")], number, weight, k)


def _vectors_list(spark: SparkSession, sf_dir: str, k: int, number: int) -> DataFrame:
    away = knn.with_distance(_scaled(spark, sf_dir).where("vec_id <> 0"), "v", _asked(spark, sf_dir), "cosine").withColumnRenamed("vec_id", "id")
    return fusion.ranked(away.select("id", "distance"), [F.round("distance", 6), F.col("id")], number, 1.0, k)


def _fused(lists: list[DataFrame], k: int) -> DataFrame:
    return fusion.fused(lists).orderBy(*fusion.order()).limit(k).select("id", F.round("score", 9).alias("score"))


@query("rrf_two_way", _fused_sql([_WORD_LIST(OR_TERMS, "or", 20, 1, 1.0), _VEC_LIST(20, 2, 1.0)], 20))
def rrf_two_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused([_words_list(spark, sf_dir, OR_TERMS, "or", 20, 1), _vectors_list(spark, sf_dir, 20, 2)], 20)


@query("rrf_weighted_and_or", _fused_sql([_WORD_LIST(AND_TERMS, "and", 20, 1, 1.0), _WORD_LIST(AND_TERMS, "or", 20, 2, 0.5)], 20))
def rrf_weighted_and_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = bm25.measured(_texts(spark, sf_dir), "text", AND_TERMS)
    return _fused([_words_list(spark, sf_dir, AND_TERMS, "and", 20, 1, counts=counts), _words_list(spark, sf_dir, AND_TERMS, "or", 20, 2, 0.5, counts)], 20)


@query("hybrid_search", _fused_sql([_WORD_LIST(AND_TERMS, "and", 20, 1, 1.0), _WORD_LIST(AND_TERMS, "or", 20, 2, 0.5), _VEC_LIST(20, 3, 1.0)], 10))
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = bm25.measured(_texts(spark, sf_dir), "text", AND_TERMS)
    lists = [_words_list(spark, sf_dir, AND_TERMS, "and", 20, 1, counts=counts), _words_list(spark, sf_dir, AND_TERMS, "or", 20, 2, 0.5, counts), _vectors_list(spark, sf_dir, 20, 3)]
    return _fused(lists, 10)


_FAN = f"""
WITH w AS (SELECT doc_id AS id, lang, 1 AS list, row_number() OVER (PARTITION BY lang ORDER BY round(bm25, 6) DESC, doc_id) AS rank FROM ({_bm25_sql(OR_TERMS, tail='', pick='doc_id, lang, bm25')})),
v AS (SELECT e.vec_id AS id, d.lang, 2 AS list, row_number() OVER (PARTITION BY d.lang ORDER BY round({_COS}, 6), e.vec_id) AS rank FROM {_SCALED} e CROSS JOIN {_QUERY} JOIN documents d ON d.doc_id = e.vec_id WHERE e.vec_id <> 0),
f AS (SELECT lang, id, sum(1.0 / (60.0 + rank)) AS s, min(list * 1000000 + rank) AS first FROM (SELECT * FROM w WHERE rank <= 20 UNION ALL SELECT * FROM v WHERE rank <= 20) GROUP BY lang, id),
r AS (SELECT lang, id, row_number() OVER (PARTITION BY lang ORDER BY round(s, 12) DESC, first, id) AS rank FROM f)
SELECT lang, id, round(1.0 / (60.0 + rank), 9) AS score FROM r ORDER BY rank, lang, id LIMIT 40"""


@query("category_fanout_rrf", _FAN)
def category_fanout_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _ranked_words(spark, sf_dir, OR_TERMS).withColumnRenamed("doc_id", "id")
    away = knn.with_distance(_scaled(spark, sf_dir).where("vec_id <> 0"), "v", _asked(spark, sf_dir), "cosine").select(F.col("vec_id").alias("doc_id"), "distance")
    near = away.join(_t(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").withColumnRenamed("doc_id", "id")
    lists = [
        fusion.ranked(words, [F.round("bm25", 6).desc(), F.col("id")], 1, 1.0, 20, ["lang"]),
        fusion.ranked(near, [F.round("distance", 6), F.col("id")], 2, 1.0, 20, ["lang"]),
    ]
    out = fusion.fanned_out(lists, "lang")
    return out.orderBy("first_rank", "lang", "id").limit(40).select("lang", "id", F.round("score", 9).alias("score"))


@query("category_counts", "SELECT lang AS category, count(*) AS n FROM documents GROUP BY lang")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").groupBy(F.col("lang").alias("category")).agg(F.count("*").alias("n"))


# -- shaping of results

_WORDS = [w for w in SNIPPET_QUERY.split() if len(w) > 2]
_TF = lambda w: f"((length(lower(text)) - length(replace(lower(text), '{w}', ''))) / {len(w)})"
_SCORE = lambda w: f"(CASE WHEN contains(lower(text), '{w}') THEN floor({_TF(w)}) * 2.2 / (floor({_TF(w)}) + 1.2 * (0.25 + 0.75 * length(text) / 500.0)) * {(0.1 if w in X.STOPWORDS else 1.0) * min(len(w) / 5, 1.5)} END)"
_SCORED = f"SELECT doc_id, coalesce(text, '') AS text, {', '.join(f'{_SCORE(w)} AS s{k}' for k, w in enumerate(_WORDS))} FROM documents"
_VALUE = " + ".join(f"CASE WHEN contains(lower(l), '{w}') THEN coalesce(s{k}, 1.0) ELSE 0.0 END" for k, w in enumerate(_WORDS))


@query(
    "snippet_best_line",
    f"""WITH a AS ({_SCORED}), b AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines, list_transform(string_split(text, chr(10)), lambda l: {_VALUE}) AS vals FROM a),
    c AS (SELECT *, list_max(vals) AS top, list_position(vals, list_max(vals)) AS best FROM b)
    SELECT doc_id, md5(CASE WHEN len(lines) <= 5 THEN text WHEN top > 0 THEN array_to_string(lines[greatest(best - 2, 1):least(best + 2, len(lines))], chr(10)) ELSE array_to_string(lines[1:5], chr(10)) END) AS snippet_md5 FROM c""",
)
def snippet_best_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text").withColumn("s", X.term_scores(F.col("text"), SNIPPET_QUERY))
    return docs.select("doc_id", F.md5(F.encode(X.snippet(F.col("text"), F.col("s"), SNIPPET_QUERY), "UTF-8")).alias("snippet_md5"))


@query(
    "highlight_terms",
    f"""WITH a AS ({_SCORED}), e AS (SELECT doc_id, unnest([{', '.join(f"{{'term': '{w}', 'score': s{k}, 'place': {k}}}" for k, w in enumerate(_WORDS))}]) AS x FROM a)
    SELECT a.doc_id, coalesce(h.terms, '') AS terms FROM a LEFT JOIN (SELECT doc_id, string_agg(x.term, ',' ORDER BY x.score DESC, x.place) AS terms FROM e WHERE x.score IS NOT NULL GROUP BY doc_id) h USING (doc_id)""",
)
def highlight_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(X.highlights(X.term_scores(F.col("text"), SNIPPET_QUERY)), ",").alias("terms"))


_MD = "'# ' || lang || ' ' || source || chr(10) || 'body' || chr(10) || '```' || chr(10) || '# code' || chr(10) || '```' || chr(10) || '###  ' || doc_id || chr(10) || '#none'"


@query("extract_headers", f"SELECT doc_id, array_to_string(list_transform(list_filter(string_split(regexp_replace({_MD}, '(?s)```.*?```', '', 'g'), chr(10)), lambda l: regexp_matches(l, '^#{{1,6}}\\s')), lambda l: regexp_replace(l, '^#{{1,6}}\\s+', '')), chr(10)) AS headers FROM documents")
def extract_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("# "), "lang", F.lit(" "), "source", F.lit("\nbody\n```\n# code\n```\n###  "), F.col("doc_id").cast("string"), F.lit("\n#none"))
    return _t(spark, sf_dir, "documents").select("doc_id", X.headings(text).alias("headers"))


@query("dedupe_best_per_parent", "SELECT conv_id, max(length(text))::BIGINT AS score, arg_min(turn, (-length(text)) * 100000 + turn) AS turn FROM conversations GROUP BY conv_id")
def dedupe_best_per_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    best = F.min_by("turn", F.struct(-n, F.col("turn")))
    return _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max(n).cast("long").alias("score"), best.alias("turn"))


@query("overlap_at_k", f"SELECT id FROM ({_WORD_LIST(OR_TERMS, 'or', 50, 1, 1.0)}) INTERSECT SELECT id FROM ({_VEC_LIST(50, 2, 1.0)})")
def overlap_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.overlap(_words_list(spark, sf_dir, OR_TERMS, "or", 50, 1), _vectors_list(spark, sf_dir, 50, 2))


@query("bm25_rerank_lexical", f"""
    WITH b AS ({_bm25_sql(OR_TERMS, tail='ORDER BY round(bm25, 6) DESC, doc_id LIMIT 30')}), t AS (SELECT b.doc_id, b.bm25, {_TOK} AS tok FROM b JOIN documents USING (doc_id))
    SELECT doc_id, round(1 / (1 + exp(-({' + '.join(f"ln(1 + len(list_filter(tok, lambda x: x = '{w}')))" for w in OR_TERMS)} - 1.5))), 6) AS score FROM t""")
def bm25_rerank_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    best = fusion.ranked(_ranked_words(spark, sf_dir, OR_TERMS), [F.round("bm25", 6).desc(), F.col("doc_id")], 0, limit=30).select("doc_id", "rank", F.col("bm25").alias("score"))
    found = docs.select("doc_id", F.col("text").alias("content")).join(F.broadcast(best), "doc_id")  # 30 rows
    return rerank.lexical()(" ".join(OR_TERMS), found).select("doc_id", F.round("score", 6).alias("score"))


# -- chunks


@query("chunk_markdown")
def chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"))
    return chunked(docs, markdown_chunker()).select("id", "parent_id", "chunk_index", F.md5(F.encode("content", "UTF-8")).alias("content_md5"), "chunk.start", "chunk.end", "chunk.first_line", "chunk.last_line")


@query(
    "chunk_line_ranges",
    """SELECT doc_id, s AS start, (length(substr(text, 1, s)) - length(replace(substr(text, 1, s), chr(10), '')) + 1)::BIGINT AS first_line,
    (length(substr(text, 1, s + 1000)) - length(replace(substr(text, 1, s + 1000), chr(10), '')) + 1)::BIGINT AS last_line
    FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1)::BIGINT, 1000)) AS s FROM documents WHERE text IS NOT NULL)""",
)
def chunk_line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    each = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.greatest(F.length("text"), F.lit(1)) - 1, F.lit(1000))).alias("start"))
    return each.select("doc_id", F.col("start").cast("long").alias("start"), X.line_at(F.col("text"), F.col("start")).cast("long").alias("first_line"), X.line_at(F.col("text"), F.col("start") + 1000).cast("long").alias("last_line"))


@query("code_chunks")
def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.regexp_replace(F.col("text"), r"[^\p{L} ]", "")
    name = F.col("doc_id").cast("string")
    source = F.concat(F.lit("import { a } from './a'\nexport function f"), name, F.lit("(x: string): string {\n  return '"), line, F.lit("'\n}\nexport class C"), name, F.lit(" {\n  run() { return 1 }\n}\n"))
    docs = _t(spark, sf_dir, "documents").select(F.concat(name, F.lit(".ts")).alias("id"), source.alias("content"))
    return chunked(docs, code_chunker()).select("id", "parent_id", "chunk_index", F.transform("chunk.entities", lambda e: e["name"]).alias("names"))


# -- maintenance


@query("list_parent_ids", "SELECT DISTINCT split_part(conv_id || '#chunk-' || turn, '#chunk-', 1) AS id FROM conversations")
def list_parent_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _t(spark, sf_dir, "conversations").select(F.concat(F.col("conv_id").cast("string"), F.lit("#chunk-"), F.col("turn").cast("string")).alias("id"))
    return ids.select(F.substring_index("id", "#chunk-", 1).alias("id")).distinct()


@query("remove_anti_join", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 AND doc_id IS NOT NULL)")
def remove_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without(_t(spark, sf_dir, "documents").select("doc_id", "lang"), _t(spark, sf_dir, "labels").where("quality = 0"), "doc_id")


@query("upsert_union", "SELECT doc_id AS id, 'q' || quality AS value FROM labels UNION ALL SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def upsert_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("value"))
    new = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("value"))
    return upserted(old, new, "id")


@query("embedding_cache_misses", "SELECT DISTINCT sha256(coalesce(text, '')) AS hash FROM documents WHERE sha256(coalesce(text, '')) NOT IN (SELECT sha256(text) FROM conversations)")
def embedding_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = _t(spark, sf_dir, "conversations").select(X.content_hash(F.col("text")).alias("hash"))
    return embed.cache_misses(_t(spark, sf_dir, "documents"), cache, "text").select("hash")


_SIZE = "least(64, n - {at}, greatest(1, 8192 // greatest(1, (l.chars + 3) // 4)))"


@query(
    "embed_batch_plan",
    f"""WITH RECURSIVE l AS (SELECT row_number() OVER (ORDER BY chars) - 1 AS i, chars FROM (SELECT coalesce(length(text), 0) AS chars FROM documents)), c AS (SELECT count(*) AS n FROM l),
    b AS (SELECT 0::BIGINT AS batch, 0::BIGINT AS at, {_SIZE.format(at="0")}::BIGINT AS size FROM c JOIN l ON l.i = least(64, n) - 1
    UNION ALL SELECT batch + 1, b.at + size, {_SIZE.format(at="(b.at + b.size)")}::BIGINT FROM b CROSS JOIN c JOIN l ON l.i = least(b.at + b.size + 64, n) - 1 WHERE b.at + b.size < n)
    SELECT batch, size AS texts, l.chars::BIGINT AS longest FROM b JOIN l ON l.i = b.at + b.size - 1""",
)
def embed_batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = _t(spark, sf_dir, "documents").groupBy(F.coalesce(F.length("text"), F.lit(0)).alias("chars")).agg(F.count("*").alias("n")).orderBy("chars").collect()  # one row for each length
    rows, first = [], 0
    for times, size, longest in embed.batch_runs([(r["chars"], r["n"]) for r in lengths]):
        rows.append((first, times, size, longest))
        first += times
    runs = spark.createDataFrame(rows, "first long, times long, texts long, longest long")
    return runs.select(F.explode(F.sequence("first", F.col("first") + F.col("times") - 1)).alias("batch"), "texts", "longest")


# -- evaluation: in each language the labelled documents by length are a ranked list, quality its relevance

_LIST = "(SELECT lang, rank, relevant FROM (SELECT d.lang, l.quality AS relevant, row_number() OVER (PARTITION BY d.lang ORDER BY d.n_chars DESC, d.doc_id) AS rank FROM documents d JOIN labels l ON d.doc_id = l.doc_id))"


def _list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(_t(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("relevant")), "doc_id")
    return fusion.ranked(docs, [F.col("n_chars").desc(), F.col("doc_id")], 0, by=["lang"]).select("lang", "rank", "relevant")


@query("eval_ndcg", f"""SELECT lang, round(CASE WHEN most > 0 THEN got / most ELSE 0.0 END, 6) AS ndcg FROM (
    SELECT lang, sum(relevant / log2(rank + 1)) AS got, sum(relevant / log2(best + 1)) AS most FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY relevant DESC, rank) AS best FROM {_LIST}) GROUP BY lang)""")
def eval_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ndcg(_list(spark, sf_dir), ["lang"]).select("lang", F.round("ndcg", 6).alias("ndcg"))


@query("eval_mrr", f"SELECT round(avg(rr), 6) AS mrr FROM (SELECT lang, coalesce(1.0 / min(CASE WHEN relevant = 1 THEN rank END), 0.0) AS rr FROM {_LIST} GROUP BY lang)")
def eval_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.reciprocal_rank(_list(spark, sf_dir), ["lang"]).agg(F.round(F.avg("rr"), 6).alias("mrr"))


@query("eval_hit_at_k", f"SELECT lang, max(CASE WHEN rank <= 3 THEN relevant ELSE 0 END)::INTEGER AS hit FROM {_LIST} GROUP BY lang")
def eval_hit_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.hit_at(_list(spark, sf_dir), ["lang"], 3)


@query("eval_precision", f"SELECT lang, round(avg(relevant), 6) AS precision FROM {_LIST} GROUP BY lang")
def eval_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.precision(_list(spark, sf_dir), ["lang"]).select("lang", F.round("precision", 6).alias("precision"))


@query("eval_keyword_hits", f"SELECT count(*) AS k, sum(CASE WHEN contains(lower(d.text), 'ther') OR contains(lower(d.text), 'chen') THEN 1 ELSE 0 END)::BIGINT AS hits FROM ({_bm25_sql(OR_TERMS, tail='ORDER BY round(bm25, 6) DESC, doc_id LIMIT 5')}) b JOIN documents d USING (doc_id)")
def eval_keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.broadcast(_best(_ranked_words(spark, sf_dir, OR_TERMS), 5))  # five rows
    found = _t(spark, sf_dir, "documents").select("doc_id", "text").join(best, "doc_id")
    return found.agg(F.count("*").alias("k"), F.sum(metrics.keyword_hit(F.col("text"), ["ther", "chen"]).cast("long")).alias("hits"))


# -- the index


@query("bm25_porter")
def bm25_porter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    index = written(bm25.clustered(written(bm25.postings(docs, "doc_id", ["text"]), "postings")), "index")
    rows, tokens = docs.count(), index.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
    best = bm25.search(index, rows, tokens, ["that", "with", "of the"])
    return knn.nearest(best, 10, [F.round("bm25", 6).desc(), "id"]).select(F.col("id").alias("doc_id"), F.round("bm25", 6).alias("bm25"))


# -- the engine as a whole: documents indexed, replaced, removed and searched. Their words are keys that no stemmer changes.

_CONTENT = "concat_ws(' ', lang, source, 'k' || (n_chars % 89), 'z' || quality)"
_INDEXED = f"(SELECT 'd' || d.doc_id AS id, d.doc_id, d.lang, d.source, d.n_chars, l.quality, {_CONTENT} AS content FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
_ASKED = "src1 k7"


def _features(texts: Sequence[str]) -> list[list[float]]:
    """A model that SQL can follow: characters, and occurrences of some."""
    return [[float(len(t)), *(2.0 * t.count(c) for c in "1es")] for t in texts]


_FEATURES = lambda x: f"[length({x})::DOUBLE, " + ", ".join(f"2.0 * (length({x}) - length(replace({x}, '{c}', '')))" for c in "1es") + "]"


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    content = F.concat_ws(" ", "lang", "source", F.concat(F.lit("k"), (F.col("n_chars") % 89).cast("string")), F.concat(F.lit("z"), F.col("quality").cast("string")))
    return docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), content.alias("content"), F.to_json(F.struct("lang", "n_chars", F.lit("old").alias("category"))).alias("metadata"), "lang", "quality")


def _engine(spark: SparkSession, sf_dir: str, **options: object) -> SearchEngine:
    engine = SearchEngine(spark, **{"mode": "keyword", **options})
    engine.index(_indexed(spark, sf_dir))
    return engine


def _found(engine: SearchEngine, asked: str = _ASKED, **options: object) -> DataFrame:
    return engine.search(asked, **options).select("rank", "id", F.round("score", 6).alias("score"))


def _engine_words(table: str, text: str, where: str = "TRUE") -> str:
    """CTEs e_and and e_or (id, rank) of the words' lists for _ASKED; text holds the words of all fields, table has id and content."""
    words = _ASKED.split()
    return f"""t AS (SELECT *, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+') AS tok FROM {table}), c AS (SELECT count(*) AS n, sum(len(tok)) / count(*) AS mean FROM t),
    f AS (SELECT t.id, q.term, len(t.tok) AS dl, len(list_filter(t.tok, lambda x: x = q.term)) AS tf FROM t CROSS JOIN (SELECT unnest({words!r}) AS term) q),
    h AS (SELECT * FROM f WHERE tf > 0), d AS (SELECT term, count(*) AS df FROM h GROUP BY term),
    i AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM d CROSS JOIN c),
    s AS (SELECT h.id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS bm25, count(*) AS hits FROM h JOIN i USING (term) CROSS JOIN c GROUP BY h.id),
    w AS (SELECT s.* FROM s JOIN t USING (id) WHERE {where}),
    e_and AS (SELECT id, row_number() OVER (ORDER BY round(bm25, 9) DESC, id) AS rank FROM w WHERE hits = {len(words)}),
    e_or AS (SELECT id, row_number() OVER (ORDER BY round(bm25, 9) DESC, id) AS rank FROM w)"""


def _engine_sql(lists: Sequence[tuple[str, float]], first: str, most: int = 20, limit: int = 10) -> str:
    """The fused lists (CTE, weight) after the CTEs `first`."""
    rows = " UNION ALL ".join(f"SELECT id, {k} AS list, rank, {w} AS weight FROM {name} WHERE rank <= {most}" for k, (name, w) in enumerate(lists))
    return f"""WITH {first}, r AS ({rows}), g AS (SELECT id, sum(weight / (60.0 + rank)) AS score, min(list * 1000000 + rank) AS place FROM r GROUP BY id)
    SELECT (row_number() OVER (ORDER BY round(score, 12) DESC, place, id))::INTEGER AS rank, id, round(score, 6) AS score FROM g ORDER BY rank LIMIT {limit}"""


_KEYWORD = [("e_and", 1.0), ("e_or", 0.5)]
_WHERE = {"lang": {"$in": ["en", "fr"]}, "n_chars": {"$gte": 400}}


@query("engine_keyword", _engine_sql(_KEYWORD, _engine_words(_INDEXED, "id || ' ' || content")))
def engine_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(_engine(spark, sf_dir))


@query("engine_filtered", _engine_sql(_KEYWORD, _engine_words(_INDEXED, "id || ' ' || content", "t.lang IN ('en', 'fr') AND t.n_chars >= 400")))
def engine_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(_engine(spark, sf_dir, fields={"n_chars": "long"}), where=_WHERE)


_KEPT = "(SELECT id, CASE WHEN quality = 1 THEN 'src1 anew k7' ELSE content END AS content FROM {} WHERE quality IS DISTINCT FROM 0)".format(_INDEXED)


def _changed(spark: SparkSession, sf_dir: str, **options: object) -> SearchEngine:
    """Documents of quality 1 indexed anew with other words, those of quality 0 removed."""
    engine = _engine(spark, sf_dir, **options)
    docs = _indexed(spark, sf_dir)
    engine.index(docs.where("quality = 1").withColumn("content", F.lit("src1 anew k7")))
    engine.remove(docs.where("quality = 0").select("id"))
    return engine


@query("engine_upsert_remove", _engine_sql(_KEYWORD, _engine_words(_KEPT, "id || ' ' || content")))
def engine_upsert_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(_changed(spark, sf_dir))


@query("engine_compacted_ids", f"SELECT id, content = 'src1 anew k7' AS anew FROM {_KEPT}")
def engine_compacted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _changed(spark, sf_dir)
    engine.compact()
    return engine.list_ids().join(engine.store.read("chunks").select("id", (F.col("content") == "src1 anew k7").alias("anew")), "id")


@query("engine_category", f"SELECT id, lang AS category, n_chars::BIGINT AS n_chars FROM {_INDEXED} WHERE lang = 'fr' AND n_chars < 300")
def engine_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, sf_dir, categorize=F.substring_index("content", " ", 1))
    kept = filters.filtered(engine.store.read("chunks").select("id", "metadata"), {"category": "fr", "n_chars": {"$lt": 300}}, filters.json("metadata"))
    of = lambda key, kind: F.expr(f"try_variant_get(try_parse_json(metadata), '$.{key}', '{kind}')")
    return kept.select("id", of("category", "string").alias("category"), of("n_chars", "bigint").alias("n_chars"))


_ENGINE_NEAR = f"near AS (SELECT id, list_distance({_FEATURES('content')}, {_FEATURES(repr(_ASKED))}) AS distance FROM {_INDEXED}), e_vec AS (SELECT id, distance, row_number() OVER (ORDER BY round(distance, 9), id) AS rank FROM near)"


@query("engine_vector", f"WITH {_ENGINE_NEAR} SELECT rank::INTEGER AS rank, id, round(1 / (1 + distance), 6) AS score FROM e_vec WHERE rank <= 10")
def engine_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(_engine(spark, sf_dir, mode="vector", embeddings=embed.Provider(lambda: _features, 4)))


@query("engine_hybrid", _engine_sql([*_KEYWORD, ("e_vec", 1.0)], _engine_words(_INDEXED, "id || ' ' || content") + ", " + _ENGINE_NEAR))
def engine_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = SearchEngine(spark, embeddings=embed.Provider(lambda: _features, 4))
    engine.index(_indexed(spark, sf_dir).drop("metadata"))
    return _found(engine)


FLAGSHIP = "hybrid_search"
