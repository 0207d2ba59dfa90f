"""Reranking of the few candidates of a search."""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import term_count, terms
from millrace.operators.embed import Transport, post

Reranker = Callable[[str, DataFrame], DataFrame]
"""(query, candidates with columns content and rank) -> candidates with score and rank replaced."""


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def _placed(df: DataFrame) -> DataFrame:
    """By score, those without content last; rank as a column. Candidates are few: at most three times a search's limit."""
    from pyspark.sql import Window

    order = [F.col("score").isNull(), F.col("score").desc(), F.col("rank")]
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))).drop("rank").withColumnRenamed("__rank", "rank")


def _kept_score(df: DataFrame, score: Column) -> DataFrame:
    has = F.col("content").isNotNull() & (F.col("content") != "")
    out = _placed(df.withColumn("__old", F.col("score")).withColumn("score", F.when(has, score)))
    return out.withColumn("score", F.coalesce("score", "__old")).drop("__old")


def lexical() -> Reranker:
    """Without a model: the logistic of the share of query terms in a candidate, and how often they occur."""

    def run(query: str, df: DataFrame) -> DataFrame:
        words = list(dict.fromkeys(w.lower() for w in query.split()))
        tokens = terms(F.col("content"))
        hits = sum((F.log1p(term_count(tokens, w)) for w in words), F.lit(0.0))
        return _kept_score(df, sigmoid(hits - F.lit(len(words) / 2)))

    return run


def cross_encoder(load: Callable[[], Callable[[Sequence[tuple[str, str]]], Sequence[float]]]) -> Reranker:
    """A model of pairs (query, content) that gives logits, loaded once in each task; scores are their logistic."""

    def run(query: str, df: DataFrame) -> DataFrame:
        @F.pandas_udf("double")
        def logits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for contents in batches:
                yield pd.Series([float(x) for x in model([(query, c or "") for c in contents])])

        return _kept_score(df, sigmoid(logits(F.col("content"))))

    return run


SERVICES = {
    "cohere": ("https://api.cohere.com/v2", "rerank-v3.5", "COHERE_API_KEY"),
    "jina": ("https://api.jina.ai/v1", "jina-reranker-v2-base-multilingual", "JINA_API_KEY"),
}


def hosted(service: str, api_key: str | None = None, model: str | None = None, url: str | None = None, top_n: int | None = None, transport: Transport = post) -> Reranker:
    """A hosted reranker. Candidates that its answer leaves out are dropped; those without content follow unscored."""
    base, default, env = SERVICES[service]
    key = api_key or os.environ.get(env)
    if not key:
        raise ValueError(f"{service} needs an API key: pass api_key or set {env}")

    def run(query: str, df: DataFrame) -> DataFrame:
        rows = df.orderBy("rank").collect()  # a search's candidates
        have, rest = [r for r in rows if r["content"]], [r for r in rows if not r["content"]]
        if not have:
            return df
        body = {"model": model or default, "query": query, "documents": [r["content"] for r in have], **({"top_n": top_n} if top_n else {})}
        answer = transport(f"{url or base}/rerank", {"Authorization": f"Bearer {key}"}, body)["results"]
        best = sorted(answer, key=lambda a: -a["relevance_score"])
        out = [{**have[a["index"]].asDict(recursive=False), "score": float(a["relevance_score"])} for a in best] + [r.asDict(recursive=False) for r in rest]
        rows = [tuple({**r, "rank": k}[c] for c in df.columns) for k, r in enumerate(out, 1)]
        return df.sparkSession.createDataFrame(rows, df.schema)

    return run


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-x))
