"""Readers that give documents (id, content, metadata as JSON text or columns)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.chunking.markdown import split_text


def file_tree(spark: SparkSession, root: str, endings: Sequence[str] = ("js", "mjs", "cjs")) -> DataFrame:
    """A document for each file under root with one of the endings; its id is the path below root."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{" + ",".join(endings) + "}")
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/")
    return files.select(F.substring(path, F.lit(len(root.rstrip("/")) + 2), F.length(path)).alias("id"), F.col("value").alias("content"))


def sections(df: DataFrame, text: str = "text", id_col: str = "id", size: int = 1500, overlap: int = 200) -> DataFrame:
    """(id, title, content): texts cut where a blank line precedes a first-level heading; the title is the first line. Sections longer than `size` are cut again, the pieces numbered under their section."""

    @F.pandas_udf("array<string>")
    def pieces(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([[c.text for c in split_text(t, size, overlap)] for t in batch], dtype=object)

    each = df.select(F.col(id_col), F.posexplode(F.split(F.col(text), r"\n\n(?=# [A-Z])")).alias("__at", "content"))
    each = each.where(F.trim("content") != "")
    title = F.regexp_replace(F.substring_index("content", "\n", 1), r"^#\s+", "")
    name = F.concat(F.col(id_col).cast("string"), F.lit("#"), F.col("__at"))
    whole = each.select(name.alias("id"), title.alias("title"), "content")
    long = F.length("content") > size
    cut = whole.where(long).select("id", "title", F.posexplode(pieces("content")).alias("__k", "content"))
    return whole.where(~long).unionByName(cut.select(F.concat("id", F.lit("."), F.col("__k")).alias("id"), "title", "content"))


def front_matter(df: DataFrame, text: str = "text", fields: Sequence[str] = ("id", "source", "title", "chunk")) -> DataFrame:
    """df with a column for each field of the block between dashed lines at a text's start, and `content`, what follows it."""
    head = F.regexp_extract(F.col(text), r"^---\n(?s:(.*?))\n---", 1)
    value = lambda f: F.regexp_extract(head, rf"(?m)^{f}:\s*(.*?)\s*$", 1)
    out = {f: F.when(value(f) != "", F.regexp_replace(value(f), r"^([\"'])(.*)\1$", "$2")) for f in fields}
    return df.withColumns({**out, "content": F.regexp_replace(F.col(text), r"^---\n(?s:.*?)\n---\n*", "")})


def jdbc(spark: SparkSession, url: str, table: str, where: str = "", **options: str) -> DataFrame:
    """A table of a store reached by JDBC; `where` (filters.to_sql with its values put in by the caller) runs there."""
    query = f"(SELECT * FROM {table}{' WHERE ' + where if where else ''}) AS t"
    return spark.read.format("jdbc").option("url", url).option("dbtable", query).options(**options).load()


def to_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    """Write df to a table of a store reached by JDBC; arrays, such as embeddings, go as JSON text, which vector columns take."""
    from pyspark.sql import types as T

    plain = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType) else F.col(f.name) for f in df.schema]
    df.select(*plain).write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode(mode).save()


def upsert_sql(table: str, staged: str, columns: Sequence[str], key: str = "id", dialect: str = "postgres") -> str:
    """The statement that moves rows of one table into another, in place of those of the same key. dialect: "postgres" (also new SQLite) or "libsql"."""
    names = ", ".join(columns)
    if dialect == "libsql":
        return f"INSERT OR REPLACE INTO {table} ({names}) SELECT {names} FROM {staged}"
    new = ", ".join(f"{c} = excluded.{c}" for c in columns if c != key)
    return f"INSERT INTO {table} ({names}) SELECT {names} FROM {staged} WHERE true ON CONFLICT ({key}) DO {f'UPDATE SET {new}' if new else 'NOTHING'}"


def upsert_jdbc(df: DataFrame, url: str, table: str, key: str = "id", dialect: str = "postgres", **options: str) -> None:
    """Write df to a table of a store reached by JDBC in place of rows of the same key: all tasks write to a staging table, and one statement, one transaction, moves it over. One row of each key is kept."""
    staged = f"{table}_staged"
    df = df.dropDuplicates([key])
    to_jdbc(df, url, staged, "overwrite", **options)
    jvm = df.sparkSession._jvm
    if driver := options.get("driver"):
        jvm.java.lang.Class.forName(driver)
    at = jvm.java.util.Properties()
    for k, v in options.items():
        at.setProperty(k, v)
    connection = jvm.java.sql.DriverManager.getConnection(url, at)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        statement.executeUpdate(upsert_sql(table, staged, df.columns, key, dialect))
        statement.executeUpdate(f"DROP TABLE {staged}")
        connection.commit()
    finally:
        connection.close()


def nearest_sql(table: str, columns: Sequence[str], query: Sequence[float], k: int, vector: str = "embedding", metric: str = "cosine", where: str = "") -> str:
    """The k nearest rows of a Postgres table with a vector column, with their distance; for jdbc(), whose database then uses its own index."""
    sign = {"cosine": "<=>", "l2": "<->", "ip": "<#>"}[metric]
    q = "'[" + ",".join(repr(float(x)) for x in query) + "]'"
    return f"SELECT {', '.join(columns)}, {vector} {sign} {q} AS distance FROM {table}{' WHERE ' + where if where else ''} ORDER BY {vector} {sign} {q} LIMIT {k}"
