"""Readers and the store."""

import sqlite3
from types import SimpleNamespace

import pytest

from millrace.session import clean, drop_written, fresh, shared_dir, written
from millrace.sources import readers
from millrace.sources.store import REMOVED, Store, upserted, without


def test_file_tree(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    for name in ("x.js", "a/y.mjs", "a/b/z.cjs", "a/no.txt"):
        (tmp_path / name).write_text(f"// {name}\nline 2\n")
    rows = {r["id"]: r["content"] for r in readers.file_tree(spark, str(tmp_path)).collect()}
    assert rows == {n: f"// {n}\nline 2\n" for n in ("x.js", "a/y.mjs", "a/b/z.cjs")}


def test_sections(spark):
    df = spark.createDataFrame([("f", "# One\nbody\n\n# Two\nmore\n\n# not\n\ntext")], "id string, text string")
    assert [tuple(r) for r in readers.sections(df).collect()] == [("f#0", "One", "# One\nbody"), ("f#1", "Two", "# Two\nmore\n\n# not\n\ntext")]


def test_long_sections_are_cut_again(spark):
    long = "# Two\n" + "words and more words\n" * 200
    df = spark.createDataFrame([(7, f"# One\nbody\n\n{long}")], "id int, text string")
    rows = readers.sections(df).orderBy("id").collect()
    assert [r["id"] for r in rows][:2] == ["7#0", "7#1.0"] and {r["title"] for r in rows[1:]} == {"Two"} and len(rows) > 3
    assert all(len(r["content"]) <= 1500 + 200 for r in rows) and rows[1]["content"].startswith("# Two")
    assert readers.sections(df.limit(0)).collect() == []


@pytest.mark.parametrize("dialect", ["postgres", "libsql"])
def test_upsert_statements_replace_by_key(dialect):
    db = sqlite3.connect(":memory:")
    db.execute("create table t (id text primary key, content text, n int)")
    db.execute("create table t_staged (id text, content text, n int)")
    db.executemany("insert into t values (?, ?, ?)", [("a", "old", 1), ("b", "old", 2)])
    db.executemany("insert into t_staged values (?, ?, ?)", [("b", "new", 3), ("c", "new", 4)])
    db.execute(readers.upsert_sql("t", "t_staged", ["id", "content", "n"], dialect=dialect))
    assert db.execute("select * from t order by id").fetchall() == [("a", "old", 1), ("b", "new", 3), ("c", "new", 4)]
    assert readers.upsert_sql("t", "s", ["id"]).endswith("DO NOTHING")


def test_nearest_statement():
    want = "SELECT id, embedding <-> '[1.0,-0.5]' AS distance FROM t WHERE n > 1 ORDER BY embedding <-> '[1.0,-0.5]' LIMIT 4"
    assert readers.nearest_sql("t", ["id"], [1, -0.5], 4, metric="l2", where="n > 1") == want


def test_front_matter(spark):
    df = spark.createDataFrame([('---\nid: a1\ntitle: "T: x"\nsource: docs\n---\n\nBody\n---\nend',), ("no matter",), (None,)], "text string")
    rows = readers.front_matter(df).collect()
    assert (rows[0]["id"], rows[0]["title"], rows[0]["source"], rows[0]["chunk"], rows[0]["content"]) == ("a1", "T: x", "docs", None, "Body\n---\nend")
    assert rows[1]["id"] is None and rows[1]["content"] == "no matter" and rows[2]["content"] is None


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    table = lambda *rows: spark.createDataFrame(rows, "doc string, v int")
    gone = lambda *ids: spark.createDataFrame([(i,) for i in ids], "doc string")
    assert s.read("t") is None and s.segments() == []
    s.append({"t": table(("a", 1), ("b", 2)), REMOVED: gone("a", "b")})
    s.append({"t": table(("a", 3), ("a", 4)), REMOVED: gone("a")}, {"t": ("v",)})
    s.append({REMOVED: gone("b", "z")})
    assert sorted((r["doc"], r["v"]) for r in s.read("t").collect()) == [("a", 3), ("a", 4)]
    s.compact(["t"])
    assert len(s.segments()) == 1 and sorted(r["v"] for r in s.read("t").collect()) == [3, 4]
    s.append({"t": table(("a", 5)), REMOVED: gone("a")})
    assert [r["v"] for r in Store(spark, str(tmp_path / "store")).read("t").collect()] == [5]
    s.clear()
    assert s.segments() == [] and s.read("t") is None


def test_a_failed_write_changes_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    s = Store(spark, str(tmp_path / "store"))
    s.append({"t": spark.createDataFrame([("a", 1)], "doc string, v int"), REMOVED: spark.createDataFrame([("a",)], "doc string")})
    with pytest.raises(Exception, match="boom"):
        s.append({"t": spark.range(1).select(F.raise_error(F.lit("boom")).cast("string").alias("doc"))})
    assert [r["v"] for r in s.read("t").collect()] == [1]


def test_upsert_and_removal(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (2, "bb")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, upserted(old, new, "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, upserted(None, new, "id").collect())) == [(2, "c"), (3, "d")]
    assert [tuple(r) for r in without(old, new, "id").collect()] == [(1, "a")]


def test_written_tables(spark):
    df = written(spark.range(5), "five")
    assert df.count() == 5 and any(shared_dir(spark).removeprefix("file:") in f for f in df.inputFiles())
    assert written(spark.range(0), "none").count() == 0
    drop_written(df)
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0]).count()
    assert fresh(spark.range(1).toDF("H"), "h", "x", "x") == ["_h", "x", "_x"]


def test_tables_of_a_session_are_cleaned():
    """With a stand-in for a session: that of the other tests has tables in use."""
    gone = []
    path = lambda name: SimpleNamespace(getFileSystem=lambda _: SimpleNamespace(delete=lambda p, _: gone.append(name) or True))
    jvm = SimpleNamespace(org=SimpleNamespace(apache=SimpleNamespace(hadoop=SimpleNamespace(fs=SimpleNamespace(Path=path)))))
    session = SimpleNamespace(sparkContext=SimpleNamespace(_millrace_written=["a", "b"]), _jvm=jvm, _jsc=SimpleNamespace(hadoopConfiguration=lambda: None))
    assert clean(session) == 2 and gone == ["a", "b"] and clean(session) == 0
