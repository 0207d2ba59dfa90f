"""Reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 60


def ranked(df: DataFrame, order: Sequence[Column], number: int, weight: float = 1.0, limit: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """A list as fusion takes it: df with columns list (its number), rank (from 1) and weight; by: a list for each of these keys.

    Lists without keys are cut by a top-k before they are ranked, so that the rows in one task are few.
    """
    if limit is not None and not by:
        df = df.orderBy(*order).limit(limit)
    rank = F.row_number().over(Window.partitionBy(*(F.col(b) for b in by) if by else (F.lit(0),)).orderBy(*order))
    out = df.withColumn("rank", rank)
    if limit is not None:
        out = out.where(F.col("rank") <= limit)
    return out.withColumn("list", F.lit(number)).withColumn("weight", F.lit(float(weight)))


def fused(lists: Sequence[DataFrame], id_col: str = "id", carry: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """(by, id, score, first_list, first_rank, carry): sum of weight / (60 + rank) by id; carried columns take the first value that is not null.

    Order by score descending, first_list, first_rank, id: rows of equal scores stay as they first appear.
    """
    rows = reduce(lambda a, b: a.unionByName(b), (x.select(*by, id_col, "list", "rank", "weight", *carry) for x in lists))
    place = F.struct("list", "rank")
    firsts = [F.min_by(F.struct(c), F.when(F.col(c).isNotNull(), place)).getField(c).alias(c) for c in carry]
    out = rows.groupBy(*by, id_col).agg(F.sum(F.col("weight") / (F.lit(float(K)) + F.col("rank"))).alias("score"), F.min(place).alias("__first"), *firsts)
    return out.select(*by, id_col, "score", F.col("__first.list").alias("first_list"), F.col("__first.rank").alias("first_rank"), *carry)


def order(id_col: str = "id", digits: int = 12) -> list[Column]:
    return [F.round("score", digits).desc(), F.col("first_list"), F.col("first_rank"), F.col(id_col)]


def fanned_out(lists: Sequence[DataFrame], category: str, id_col: str = "id", carry: Sequence[str] = ()) -> DataFrame:
    """Fusion within each category, then of the categories' lists: the best of each come first, in the categories' order.

    One plan for all categories: ranks are windows by category and list.
    """
    within = fused(lists, id_col, carry, by=(category,))
    rank = F.row_number().over(Window.partitionBy(category).orderBy(*order(id_col)))
    across = within.withColumn("rank", rank).withColumn("weight", F.lit(1.0)).withColumn("list", F.col(category))
    return across.select(category, id_col, (F.lit(1.0) / (F.lit(float(K)) + F.col("rank"))).alias("score"), F.col(category).alias("first_list"), F.col("rank").alias("first_rank"), *carry)
