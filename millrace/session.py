"""What every operator needs of a session: the shared folder, tables that cut lineage, and the package on the workers."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Where the setting is absent (tests on one machine) a temporary folder is made, once a session.
    """
    sc = spark.sparkContext
    set_dir = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_millrace_dir", None)
    if not set_dir:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        set_dir = tempfile.mkdtemp(prefix="millrace-")
        sc._millrace_dir = set_dir
    return set_dir.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: its lineage ends there, and losing an executor costs nothing. It stays until drop_written() or clean()."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    sc = df.sparkSession.sparkContext
    sc._millrace_written = [*getattr(sc, "_millrace_written", []), path]
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete a table made by written() that no later plan reads."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = shared_dir(spark).removeprefix("file:").rstrip("/").replace("///", "/").replace("//", "/")
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root in name:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def clean(spark: SparkSession) -> int:
    """Delete all tables that this session's written() made and that are still there; for when no plan over them is left. Returns their number."""
    sc, jvm, gone = spark.sparkContext, spark._jvm, 0
    for name in getattr(sc, "_millrace_written", []):
        path = jvm.org.apache.hadoop.fs.Path(name)
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    sc._millrace_written = []
    return gone


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable on the Python workers, wherever they run: as an archive in the shared folder."""
    sc = spark.sparkContext
    if not getattr(sc, "_millrace_shipped", False):
        home, data = Path(__file__).resolve().parent, io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(home.rglob("*.py")):
                z.write(p, p.relative_to(home.parent))
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex}.zip")
        out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
        try:
            out.write(bytearray(data.getvalue()))
        finally:
            out.close()
        sc.addPyFile(target.toString())
        sc._millrace_shipped = True
    return spark


def part_bytes(total: int) -> int:
    """How large a part of so many bytes should be for one task to hold it: 32 MB, more where that makes over 10,000 parts, 512 MB at most."""
    return max(32 << 20, min(512 << 20, total // 10_000))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores put before it as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
