"""Chunkers: text in, an array of chunks out. Any function (content, id) -> list of Chunk serves as one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from millrace.operators.chunking.auto import auto_chunker
from millrace.operators.chunking.base import ENTITY, Chunk
from millrace.operators.chunking.code import code_chunker
from millrace.operators.chunking.markdown import markdown_chunker, split_text

__all__ = ["Chunk", "auto_chunker", "chunked", "code_chunker", "markdown_chunker", "split_text"]

#: Bytes of text that a task cuts before it passes the chunks on.
PART = 1 << 20
SCHEMA = (
    f"array<struct<text:string,start:int,end:int,first_line:int,last_line:int,context:string,entities:array<{ENTITY}>,scope:array<{ENTITY}>,"
    "imports:array<struct<name:string,source:string,is_default:boolean,is_namespace:boolean>>,siblings:array<struct<name:string,type:string,position:string,distance:int>>>>"
)


def parts_of(texts: pa.Array, most: int = PART) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows whose texts have about `most` bytes together; a longer text is a run by itself."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = before = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield at, stop - at
        at, before = stop, int(ends[stop - 1])


def cut(batches: Iterator[tuple[pa.Array, pa.Array]], chunker: Callable[[str, str], list[Chunk]], kind: pa.DataType, done: Accumulator | None = None) -> Iterator[pa.Array]:
    """The chunks of batches of (content, id), part by part, so that few documents are Python objects at once."""
    for contents, ids in batches:
        for at, n in parts_of(contents):
            mine = zip(contents.slice(at, n).to_pylist(), ids.slice(at, n).to_pylist(), strict=True)
            yield pa.array([[c.row() for c in chunker(t or "", i or "")] for t, i in mine], kind)
            if done is not None:
                done.add(n)


def chunk_column(chunker: Callable[[str, str], list[Chunk]], content: Column, id_col: Column, done: Accumulator | None = None) -> Column:
    """All chunks of a content column, as an array of structs; `done` counts documents."""
    kind = to_arrow_type(T.DataType.fromDDL(SCHEMA))

    @F.arrow_udf(SCHEMA)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return cut(batches, chunker, kind, done)

    return run(content, id_col)


def chunked(df: DataFrame, chunker: Callable[[str, str], list[Chunk]], id_col: str = "id", content: str = "content", done: Accumulator | None = None) -> DataFrame:
    """A row for each chunk: df's columns with id, content and parent_id, chunk_index, chunk of it. A document of one chunk stays as it is, these null.

    One map over the rows; whole documents go through a task one at a time.
    """
    rest = [c for c in df.columns if c not in (id_col, content, "parent_id", "chunk_index", "chunk")]
    each = df.withColumn("__chunks", chunk_column(chunker, F.col(content), F.col(id_col).cast("string"), done))
    many = F.size("__chunks") > 1
    each = each.withColumn("__chunks", F.when(many, F.col("__chunks")).otherwise(F.array(F.lit(None).cast(SCHEMA.removeprefix("array<")[:-1]))))
    each = each.select(F.col(id_col), F.col(content), *rest, F.posexplode("__chunks").alias("__at", "chunk"))
    whole = F.col("chunk").isNull()
    text = F.concat_ws("\n", "chunk.context", "chunk.text")
    return each.select(
        F.when(whole, F.col(id_col)).otherwise(F.concat(F.col(id_col), F.lit("#chunk-"), F.col("__at"))).alias(id_col),
        F.when(whole, F.col(content)).otherwise(text).alias(content),
        *rest,
        F.when(~whole, F.col(id_col)).alias("parent_id"),
        F.when(~whole, F.col("__at")).alias("chunk_index"),
        "chunk",
    )
