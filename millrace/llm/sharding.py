"""Sharding by a two-pass external shuffle.

The first pass scatters records uniformly into buckets small enough for one task's memory, by a seeded hash of the
whole record; the shuffle files are the buckets on disk. The second pass reads each bucket, shuffles it by
Fisher-Yates with a generator seeded by seed and bucket, and hands out positions. Buckets laid end to end are one
random permutation of all records; shards are cut from it so that their numbers of rows are at most one apart.
The result depends on the records, seed, shards and bucket size only, so a lost task is redone to the same rows.

Records that repeat in full hash alike. Those that would swell a bucket, by their number or their bytes, are counted first, travel as one record with
a number of copies for each bucket, spread evenly, and are written out again inside the bucket.

Defined results: nulls are values like others; an empty table gives an empty result; if there are fewer records than
shards, the first shards have one each. Columns named shard and slot are replaced. Columns of map type cannot be hashed
and raise Spark's error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import fresh, part_bytes, written

LEAST_BUCKETS = 4  # for small tables; a constant, so that the result does not depend on the cluster


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of n; numpy's shuffle swaps each place with a random one not after it, from the end."""
    order = np.arange(n)
    np.random.Generator(np.random.Philox(key=[seed & (1 << 64) - 1, bucket])).shuffle(order)
    return order


def record_size(text: str) -> F.Column:
    """UTF-8 bytes of the text (null: none) plus 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def shuffled(df: DataFrame, shards: int, seed: int = 0, text: str = "text", bucket_bytes: int | None = None) -> DataFrame:
    """df with columns shard (from 0) and slot (place in the shard, gapless from 0), in a seeded random order.

    bucket_bytes: what one task can hold, with room to spare; None: 32 to 512 MB, by the table's size.
    """
    names = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    df = df.select(*(F.col(f"`{c}`") for c in names))
    columns = [F.col(f"`{c}`") for c in names]
    mark = F.xxhash64(F.lit(seed), *columns)
    hash_, bucket_, copies_, n_ = fresh(df, "h", "bucket", "copies", "n")
    spark = df.sparkSession
    sizes = written(df.select(mark.alias("h"), record_size(text).alias("size")).groupBy("h").agg(F.count("*").alias("n"), F.sum("size").alias("size")), "records")
    total, size = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(1, -(-size // (bucket_bytes or part_bytes(size))), min(total, LEAST_BUCKETS))
    limit, much = max(64, total // (8 * buckets)), max(1, size // (8 * buckets))  # rows and bytes of an eighth of a bucket
    is_hot = (F.col("n") > limit) | (F.col("n") > 1) & (F.col("size") > much)
    hot = sizes.where(is_hot).select("h", "n")
    bucket = lambda h: F.pmod(F.xxhash64(h), F.lit(buckets)).cast("int")
    counts = np.zeros(buckets, np.int64)
    for r in sizes.where(~is_hot).groupBy(bucket(F.col("h")).alias("b")).agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["b"]] = r["n"]
    scattered = df.withColumn(hash_, mark)
    number = hot.count()
    if number:
        hot = hot.select(F.col("h").alias(hash_))
        hot = F.broadcast(hot) if number <= 100_000 else hot
        repeated = scattered.join(hot, hash_, "left_semi").groupBy(*columns, hash_).agg(F.count("*").alias(n_))
        each = written(repeated, "repeated")
        share = lambda b: F.floor(F.col(n_) * (b + 1) / buckets) - F.floor(F.col(n_) * b / buckets)
        spread = each.withColumn(bucket_, F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))).withColumn(copies_, share(F.col(bucket_)).cast("long")).where(F.col(copies_) > 0).drop(n_)
        for r in spread.groupBy(F.col(bucket_).alias("b")).agg(F.sum(copies_).alias("n")).toLocalIterator():
            counts[r["b"]] += r["n"]
        scattered = scattered.join(hot, hash_, "left_anti")
    single = scattered.select(*columns, hash_, bucket(F.col(hash_)).alias(bucket_), F.lit(1).cast("long").alias(copies_))
    scattered = single.unionByName(spread.select(*columns, hash_, bucket_, copies_)) if number else single
    first = spark.sparkContext.broadcast(np.concatenate(([0], np.cumsum(counts))))  # one number for each bucket
    low, extra = divmod(int(total), shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [x for x in batches if x.num_rows]
        if not parts:
            return
        held = pa.Table.from_batches(parts)
        h, b, copies = (held.column(k).to_numpy() for k in (hash_, bucket_, copies_))
        table = held.select(names)
        for one in np.unique(b):
            mine = np.flatnonzero(b == one)
            mine = mine[np.argsort(h[mine], kind="stable")]  # whatever order the shuffle brought
            mine = np.repeat(mine, copies[mine])
            start, end = int(first.value[one]), int(first.value[one + 1])
            if len(mine) != end - start:
                raise RuntimeError(f"bucket {one} has {len(mine)} records, {end - start} were counted: the input changed between reads")
            order = mine[fisher_yates(len(mine), seed, int(one))]
            at = np.arange(start, end)
            large = extra * (low + 1)
            shard = np.where(at < large, at // (low + 1), extra + (at - large) // max(low, 1))
            slot = np.where(at < large, at % (low + 1), (at - large) % max(low, 1))
            for k in range(0, len(order), 2000):
                part = table.take(pa.array(order[k : k + 2000])).append_column("shard", pa.array(shard[k : k + 2000], pa.int32())).append_column("slot", pa.array(slot[k : k + 2000], pa.int64()))
                yield from part.combine_chunks().to_batches()

    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in df.schema), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return scattered.repartitionById(buckets, F.col(bucket_)).mapInArrow(run, schema)


def write_shards(df: DataFrame, path: str, shards: int, seed: int = 0, text: str = "text", bucket_bytes: int | None = None) -> None:
    """Write shuffled(df) as Parquet under path, a folder for each shard; within a shard, slots rise over its files by name and inside them."""
    shuffled(df, shards, seed, text, bucket_bytes).write.partitionBy("shard").parquet(path)
