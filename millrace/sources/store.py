"""Tables on a shared file system, kept as segments.

A write makes a new segment beside the others and then adds a manifest, a file of the next number that lists the current
segments; readers take the manifest of the greatest number. A manifest is written under another name and renamed to its own, which
did not exist, so that at every moment one whole manifest is the newest: a write that fails or is cut off anywhere leaves the store as
it was. The cost of a write follows what is written, not what is stored. What a segment replaces or
removes stands in its table `removed`, and readers leave such rows of earlier segments out by one anti join. compact()
writes all segments as one. Segments that it or clear() leaves behind, and old manifests, are deleted by later writes, `keep` seconds after: readers that
planned over them have that long. There is one writer at a time.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REMOVED = "removed"


class Store:
    """A folder of named tables. Every table has a column `doc`, the key that a later segment replaces rows by."""

    def __init__(self, spark: SparkSession, path: str, keep: float = 3600.0):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at(self.path))

    def _names(self) -> list[str]:
        return [f.getPath().getName() for f in self._fs.listStatus(self._at(self.path))]

    def version(self) -> int:
        """The number of the newest manifest; 0 if there is none."""
        return max((int(n.removeprefix("MANIFEST-")) for n in self._names() if n.startswith("MANIFEST-")), default=0)

    def _manifest(self) -> dict:
        if not (number := self.version()):
            return {"segments": [], "left": {}}
        stream = self._fs.open(self._at(f"{self.path}/MANIFEST-{number:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def segments(self) -> list[str]:
        """Folders of the current segments, oldest first."""
        return self._manifest()["segments"]

    def _write_manifest(self, number: int, manifest: dict) -> None:
        new = self._at(f"{self.path}/_new-{uuid.uuid4().hex}")
        out = self._fs.create(new, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        target = self._at(f"{self.path}/MANIFEST-{number:012d}")
        if self._fs.exists(target) or not self._fs.rename(new, target):
            raise OSError(f"{self.path}: manifest {number} could not be added")

    def _commit(self, segments: Sequence[str]) -> None:
        number, before, now = self.version(), self._manifest(), time.time()
        left = {n: t for n, t in before["left"].items() if now - t < self.keep}
        due = [n for n in before["left"] if n not in left]
        left |= {n: now for n in before["segments"] if n not in segments}
        self._write_manifest(number + 1, {"segments": list(segments), "left": left, "time": now})
        for name in due:
            self._fs.delete(self._at(f"{self.path}/{name}"), True)
        for status in self._fs.listStatus(self._at(self.path)):
            name = status.getPath().getName()
            old = name.startswith("MANIFEST-") and int(name.removeprefix("MANIFEST-")) <= number or name.startswith("_new-")
            lost = name.startswith("s-") and name not in segments and name not in left  # of a write that was cut off
            if (old or lost) and now - status.getModificationTime() / 1000 >= self.keep:
                self._fs.delete(status.getPath(), True)

    def _write(self, tables: Mapping[str, DataFrame], sort: Mapping[str, Sequence[str]]) -> str:
        name = f"s-{uuid.uuid4().hex}"
        for table, df in tables.items():
            if keys := sort.get(table):  # ranges: a key of many rows is spread over files, and each file has few keys
                df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
            df.write.parquet(f"{self.path}/{name}/{table}")
        return name

    def append(self, tables: Mapping[str, DataFrame], sort: Mapping[str, Sequence[str]] | None = None) -> None:
        """Write the tables as a new segment. sort: columns by which a table's files are clustered, for filters to skip by."""
        before = self.segments()
        self._commit([*before, self._write(tables, sort or {})])

    def read(self, table: str) -> DataFrame | None:
        """A table without what later segments removed, with the number of the segment as `seg`; None if there is no segment with it."""
        names = self.segments()
        of = lambda t: [(k, f"{self.path}/{n}/{t}") for k, n in enumerate(names)]
        parts = [self.spark.read.parquet(path).withColumn("seg", F.lit(k)) for k, path in of(table) if self._fs.exists(self._at(path))]
        if not parts:
            return None
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        if len(names) < 2:
            return df
        gone = reduce(DataFrame.unionByName, (self.spark.read.parquet(path).select(F.col("doc").alias("__doc"), F.lit(k).alias("__seg")) for k, path in of(REMOVED)[1:]))
        last = gone.groupBy("__doc").agg(F.max("__seg").alias("__seg"))
        return df.join(last, (F.col("doc") == F.col("__doc")) & (F.col("seg") < F.col("__seg")), "left_anti")

    def compact(self, tables: Sequence[str], sort: Mapping[str, Sequence[str]] | None = None) -> None:
        """Write the live rows of all segments as one segment."""
        before = self.segments()
        if len(before) < 2:
            return
        live = {t: df.drop("seg") for t in tables if (df := self.read(t)) is not None}
        live[REMOVED] = self.spark.createDataFrame([], "doc string")
        self._commit([self._write(live, sort or {})])

    def clear(self) -> None:
        """Remove all segments."""
        self._commit([])

    def put(self, name: str, text: str) -> None:
        """A small file beside the tables."""
        out = self._fs.create(self._at(f"{self.path}/{name}"), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(f"{self.path}/{name}"), False)

    def get(self, name: str) -> str | None:
        path = self._at(f"{self.path}/{name}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


def upserted(old: DataFrame | None, new: DataFrame, key: str) -> DataFrame:
    """new, and the rows of old whose key is not in new."""
    if old is None:
        return new
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is not among the ids."""
    return df.join(ids.select(key).distinct(), key, "left_anti")
