"""Measures of ranked results: rows of (query, rank from 1, relevant 0 or 1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ndcg(df: DataFrame, by: Sequence[str], rank: str = "rank", relevant: str = "relevant") -> DataFrame:
    """(by, ndcg): discounted gain against that of the same rows in the best order; 0 without relevant rows."""
    gain = lambda r: 1 / F.log2(r + 1.0)
    ideal = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(relevant).desc(), rank))
    rows = df.withColumn("__best", ideal).groupBy(*by).agg(F.sum(F.col(relevant) * gain(F.col(rank))).alias("__got"), F.sum(F.col(relevant) * gain(F.col("__best"))).alias("__most"))
    return rows.select(*by, F.when(F.col("__most") > 0, F.col("__got") / F.col("__most")).otherwise(0.0).alias("ndcg"))


def reciprocal_rank(df: DataFrame, by: Sequence[str], rank: str = "rank", relevant: str = "relevant") -> DataFrame:
    """(by, rr): 1 over the rank of the first relevant row, 0 without one. Their mean is the MRR."""
    return df.groupBy(*by).agg(F.coalesce(1 / F.min(F.when(F.col(relevant) == 1, F.col(rank))), F.lit(0.0)).alias("rr"))


def hit_at(df: DataFrame, by: Sequence[str], k: int, rank: str = "rank", relevant: str = "relevant") -> DataFrame:
    """(by, hit): whether one of the first k rows is relevant, as 0 or 1."""
    return df.groupBy(*by).agg(F.max(F.when(F.col(rank) <= k, F.col(relevant)).otherwise(0)).cast("int").alias("hit"))


def precision(df: DataFrame, by: Sequence[str], relevant: str = "relevant") -> DataFrame:
    """(by, precision): share of relevant rows."""
    return df.groupBy(*by).agg(F.avg(F.col(relevant).cast("double")).alias("precision"))


def keyword_hit(text: Column, keywords: Sequence[str]) -> Column:
    """Whether a text holds any of the keywords, the case ignored."""
    low = F.lower(text)
    out = F.lit(False)
    for w in keywords:
        out = out | low.contains(w.lower())
    return out


def overlap(a: DataFrame, b: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids that both result lists have."""
    return a.select(id_col).intersect(b.select(id_col))
