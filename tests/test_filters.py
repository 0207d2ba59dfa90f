"""The filter language: its two dialects, its SQL, and its errors."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import filters

RECORDS = [{"x": "abc"}, {"x": "5"}, {"x": 5}, {"x": 1}, {"x": 0}, {"x": 2.5}, {"x": True}, {"x": False}, {"x": None}, {"y": 1}, {}, None, {"x": "my_file.ts"}, {"x": "myXfile.ts"}, {"x": ""}, {"x": "10"}, {"a": {"b": 3}}]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, None if r is None else json.dumps(r)) for i, r in enumerate(RECORDS)], "id int, metadata string").cache()


def found(table, where, dialect="json"):
    test = filters.compiled(where, filters.json("metadata", nested=dialect == "json"), dialect, F.col("metadata"))
    return [RECORDS[r["id"]] for r in (table.where(test) if test is not None else table).orderBy("id").collect()]


CONDITIONS = ["abc", 5, 1, True, False, {"$eq": "5"}, {"$ne": 5}, {"$ne": "abc"}, {"$gt": 1}, {"$gte": 2.5}, {"$lt": 5}, {"$lte": 0}, {"$in": [1, "abc"]}, {"$in": []}, {"$nin": [5, "5"]}, {"$nin": []}, {"$prefix": "my_"}, {"$contains": "file"}, {"$exists": True}, {"$exists": False}, {"$gt": 0, "$lt": 5}]


@pytest.mark.parametrize("condition", CONDITIONS, ids=str)
def test_memory_dialect_is_matches(table, condition):
    where = {"x": condition}
    assert found(table, where, "memory") == [r for r in RECORDS if r is not None and filters.matches(where, r) or r == {} and _empty(condition)]


def _empty(condition):
    """An empty record counts as metadata for the table, and as none in memory."""
    test = condition if isinstance(condition, dict) else {"$eq": condition}
    return filters.matches({"x": condition}, {"_": 1}) if test else True


@pytest.mark.parametrize(
    ("condition", "values"),
    [
        (5, [5]), ("5", ["5"]), (1, [1, True]), (True, [1, True]), (False, [0, False]),
        ({"$ne": 5}, ["abc", "5", 1, 0, 2.5, True, False, "my_file.ts", "myXfile.ts", "", "10"]),
        ({"$gt": 1}, ["abc", "5", 5, 2.5, "my_file.ts", "myXfile.ts", "", "10"]),
        ({"$lt": 1}, [0, False]),
        ({"$in": [1, "abc"]}, ["abc", 1, True]), ({"$in": []}, []),
        ({"$nin": [5, "5", "abc"]}, [1, 0, 2.5, True, False, "my_file.ts", "myXfile.ts", "", "10"]),
        ({"$prefix": "my_"}, ["my_file.ts"]), ({"$contains": "file"}, ["my_file.ts", "myXfile.ts"]), ({"$prefix": "5"}, ["5", 5]),
        ({"$gte": 1, "$lt": 5}, [1, 2.5, True]),
    ],
    ids=str,
)
def test_json_dialect(table, condition, values):
    assert [r["x"] for r in found(table, {"x": condition})] == values


def test_missing_fields_in_the_json_dialect(table):
    assert all(r is not None and r.get("x") is not None for r in found(table, {"x": {"$ne": "q"}}))
    assert [r for r in found(table, {"x": {"$exists": False}})] == [{"x": None}, {"y": 1}, {}, {"a": {"b": 3}}] or None in found(table, {"x": {"$exists": False}})
    assert found(table, {"a.b": 3}) == [{"a": {"b": 3}}]
    assert len(found(table, {"x": {"$nin": []}})) == len(RECORDS) == len(found(table, {}))


def test_random_filters_on_typed_columns(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "ab", "b", None]), rng.choice([1, 2, 3, None]), rng.choice([True, False, None])) for _ in range(60)]
    df = spark.createDataFrame(rows, "s string, n int, f boolean").cache()
    simple = {"s": ["a", {"$prefix": "a"}, {"$contains": "b"}, {"$in": ["a", "b"]}, {"$exists": True}], "n": [2, {"$gt": 1}, {"$lte": 2}, {"$in": [1, 3]}, {"$exists": False}], "f": [True, {"$ne": True}, {"$eq": False}]}
    for _ in range(25):
        where = {k: rng.choice(v) for k, v in simple.items() if rng.random() < 0.6}
        got = sorted(map(repr, filters.filtered(df, where, dialect="memory").collect()))
        assert got == sorted(repr(r) for r in df.collect() if filters.matches(where, {**r.asDict(), "_": 1}))


def test_filters_reach_the_scan(spark, sf, capsys):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    filters.filtered(df, {"lang": "en", "n_chars": {"$gte": 5}, "source": {"$prefix": "src1"}}).select("doc_id").explain("formatted")
    plan = capsys.readouterr().out
    assert all(x in plan for x in ("EqualTo(lang,en)", "GreaterThanOrEqual(n_chars,5)", "StringStartsWith(source,src1)"))
    filters.filtered(df, {"lang": {"$in": []}}).explain("formatted")
    assert "LocalTableScan" in capsys.readouterr().out


@pytest.mark.parametrize("where", [{"a b": 1}, {"a'; drop": 1}, {"": 1}, {"x": {"$like": 1}}, {"x": {"$gt": "a"}}, {"x": {"$in": 3}}, {"x": [1]}, {"x": {"$prefix": 3}}])
def test_errors(where):
    with pytest.raises(ValueError):
        filters.compiled(where, filters.json("metadata"))


@pytest.mark.parametrize(
    ("where", "sql", "params"),
    [
        (None, "", []), ({}, "", []),
        ({"t": "code"}, "json_extract(metadata, '$.t') = ?", ["code"]),
        ({"t": True}, "json_extract(metadata, '$.t') = ?", [1]),
        ({"n": {"$gte": 2}, "t": "x"}, "json_extract(metadata, '$.n') >= ? AND json_extract(metadata, '$.t') = ?", [2, "x"]),
        ({"t": {"$in": ["a", "b"]}}, "json_extract(metadata, '$.t') IN (?, ?)", ["a", "b"]),
        ({"t": {"$nin": ["a"]}}, "json_extract(metadata, '$.t') NOT IN (?)", ["a"]),
        ({"t": {"$in": []}}, "1 = 0", []), ({"t": {"$nin": []}}, "1 = 1", []),
        ({"t": {"$prefix": "a_%\\"}}, "json_extract(metadata, '$.t') LIKE ? ESCAPE '\\'", ["a\\_\\%\\\\%"]),
        ({"t": {"$contains": "x"}}, "json_extract(metadata, '$.t') LIKE ? ESCAPE '\\'", ["%x%"]),
        ({"t": {"$exists": True}}, "json_extract(metadata, '$.t') IS NOT NULL", []),
        ({"a.b": {"$exists": False}}, "json_extract(metadata, '$.a.b') IS NULL", []),
    ],
    ids=str,
)
def test_sql_for_json_stores(where, sql, params):
    assert filters.to_sql(where) == (sql, params)


def test_sql_for_jsonb_stores():
    assert filters.to_sql({"n": {"$gt": 5}, "t": "x"}, "jsonb", "m") == ("(m->>'n')::numeric > ? AND m->>'t' = ?", [5, "x"])
    assert filters.numbered("a = ? AND b IN (?, ?)", 3) == "a = $3 AND b IN ($4, $5)"
