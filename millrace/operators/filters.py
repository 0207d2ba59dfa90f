"""The metadata filter language: a dict of fields to values or operator objects, all of which must hold.

`compiled()` makes a Column. Dialects: "json" (default) follows typed JSON in SQL: comparisons with a missing field
are null, so the row is left out; text sorts above numbers; true and false are 1 and 0. "memory" follows in-memory
matching: types must agree, and a missing field is unequal to everything. Prefix and substring tests respect case in
both. An object may hold several operators, all of which must hold; an unknown one is an error.

Fields are typed columns, which lets Parquet skip row groups, or paths into a JSON column.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATORS = ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$prefix", "$contains", "$exists")
_FIELD = re.compile(r"^[\w.]+$", re.A)
_ORDERED = {"$gt": (lambda a, b: a > b, True), "$gte": (lambda a, b: a >= b, True), "$lt": (lambda a, b: a < b, False), "$lte": (lambda a, b: a <= b, False)}


def check_field(name: str) -> str:
    if not _FIELD.match(name):
        raise ValueError(f"invalid filter field: {name!r}")
    return name


@dataclass(frozen=True)
class Field:
    """A field as the compiler sees it; of number, text and flag, those it cannot have are None, and null where it has another."""

    present: Column
    number: Column | None = None
    text: Column | None = None
    flag: Column | None = None


Resolver = Callable[[str], Field]


def columns(df: DataFrame) -> Resolver:
    """Fields are columns of df, struct fields by dotted path."""

    def resolve(name: str) -> Field:
        c = F.col(name)
        kind = df.select(c).schema[0].dataType
        if isinstance(kind, T.BooleanType):
            return Field(c.isNotNull(), flag=c)
        if isinstance(kind, T.NumericType):
            return Field(c.isNotNull(), number=c)
        return Field(c.isNotNull(), text=c if isinstance(kind, T.StringType) else c.cast("string"))

    return resolve


def json(column: str, nested: bool = True) -> Resolver:
    """Fields are paths into a JSON text; nested: dots lead into objects, else they are part of the key."""

    def resolve(name: str) -> Field:
        v = F.try_variant_get(F.try_parse_json(F.col(column)), "$." + name if nested else f"$['{name}']", "variant")
        kind = F.schema_of_variant(v)
        as_ = lambda t: F.try_variant_get(v, "$", t)
        number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
        return Field(v.isNotNull() & (kind != "VOID"), F.when(number, as_("double")), F.when(kind == "STRING", as_("string")), F.when(kind == "BOOLEAN", as_("boolean")))

    return resolve


def _false_if_present(f: Field) -> Column:
    return F.when(f.present, F.lit(False))


def _equal(f: Field, value: object, strict: bool) -> Column:
    """Null where the field is missing."""
    if isinstance(value, bool):
        if f.flag is not None and f.number is None and f.text is None:
            return f.flag == value
        tests = [f.flag == value] if f.flag is not None else []
        if not strict and f.number is not None:
            tests.append(f.number == int(value))
    elif isinstance(value, int | float):
        if f.number is not None and f.text is None and f.flag is None:
            return f.number == value
        tests = [f.number == value] if f.number is not None else []
        if not strict and f.flag is not None and value in (0, 1):
            tests.append(f.flag == bool(value))
    elif isinstance(value, str):
        if f.text is not None and f.number is None and f.flag is None:
            return f.text == value
        tests = [f.text == value] if f.text is not None else []
    else:
        raise ValueError(f"filter values are strings, numbers and booleans, not {value!r}")
    return F.coalesce(*tests, _false_if_present(f))


def _ordered(f: Field, op: str, value: object, strict: bool) -> Column:
    if isinstance(value, bool) or not isinstance(value, int | float):
        raise ValueError(f"{op} takes a number, not {value!r}")
    test, above = _ORDERED[op]
    if f.number is not None and f.text is None and f.flag is None:
        return test(f.number, value)
    tests = [test(f.number, value)] if f.number is not None else []
    if not strict:
        if f.flag is not None:
            tests.append(test(f.flag.cast("int"), value))
        if f.text is not None:
            tests.append(F.when(f.text.isNotNull(), F.lit(above)))
    return F.coalesce(*tests, _false_if_present(f))


def _like(f: Field, op: str, value: object, strict: bool) -> Column:
    if not isinstance(value, str):
        raise ValueError(f"{op} takes a string, not {value!r}")
    test = (lambda c: c.startswith(value)) if op == "$prefix" else (lambda c: c.contains(value))
    if f.text is not None and f.number is None and f.flag is None:
        return test(f.text)
    tests = [test(f.text)] if f.text is not None else []
    if not strict and f.number is not None:
        whole = f.number == F.floor(f.number)
        tests.append(test(F.when(whole, f.number.cast("long").cast("string")).otherwise(f.number.cast("string"))))
    return F.coalesce(*tests, _false_if_present(f))


def _members(op: str, value: object) -> list[object]:
    if not isinstance(value, list | tuple | set | frozenset):
        raise ValueError(f"{op} takes a list, not {value!r}")
    return list(value)


def _in(f: Field, values: Sequence[object], strict: bool) -> Column:
    kinds = {type(v) for v in values}
    if f.text is not None and f.number is None and f.flag is None and kinds == {str}:
        return f.text.isin(*values)
    if f.number is not None and f.text is None and f.flag is None and kinds <= {int, float}:
        return f.number.isin(*values)
    return reduce(lambda a, b: a | b, (_equal(f, v, strict) for v in values))


def _test(f: Field, op: str, value: object, memory: bool) -> Column:
    if op == "$eq":
        return _equal(f, value, memory)
    if op == "$ne":
        unequal = ~_equal(f, value, memory)
        return F.coalesce(unequal, F.lit(True)) if memory else unequal
    if op in _ORDERED:
        return _ordered(f, op, value, memory)
    if op in ("$in", "$nin"):
        values = _members(op, value)
        if not values:
            return F.lit(op == "$nin")
        return _in(f, values, memory) if op == "$in" else ~_in(f, values, memory)
    if op in ("$prefix", "$contains"):
        return _like(f, op, value, memory)
    if op == "$exists":
        return f.present if value else ~f.present
    raise ValueError(f"unknown filter operator: {op}")


def compiled(where: Mapping[str, object] | None, resolve: Resolver, dialect: str = "json", metadata: Column | None = None) -> Column | None:
    """The filter as a boolean column; None for no filter. metadata: in the memory dialect, rows in which it is null never match."""
    if dialect not in ("json", "memory"):
        raise ValueError(f"unknown dialect: {dialect}")
    tests = []
    for name, condition in (where or {}).items():
        f = resolve(check_field(name))
        objects = condition.items() if isinstance(condition, Mapping) else [("$eq", condition)]
        tests += [_test(f, op, value, dialect == "memory") for op, value in objects]
    if not tests:
        return None
    if dialect == "memory" and metadata is not None:
        tests.insert(0, metadata.isNotNull())
    return reduce(lambda a, b: a & b, tests)


def filtered(df: DataFrame, where: Mapping[str, object] | None, resolve: Resolver | None = None, dialect: str = "json") -> DataFrame:
    """Rows of df that match."""
    test = compiled(where, resolve or columns(df), dialect)
    return df if test is None else df.where(test)


def matches(where: Mapping[str, object] | None, metadata: Mapping[str, object] | None) -> bool:
    """Whether one record matches under the memory dialect, in Python; for post-filtering small result lists."""
    if not where:
        return True
    if not metadata:
        return False

    def same(a: object, b: object) -> bool:
        return isinstance(a, bool) == isinstance(b, bool) and isinstance(a, str) == isinstance(b, str) and a == b

    def one(x: object, op: str, v: object) -> bool:
        number = isinstance(x, int | float) and not isinstance(x, bool)
        if op == "$eq":
            return same(x, v)
        if op == "$ne":
            return not same(x, v)
        if op in _ORDERED:
            return number and bool(_ORDERED[op][0](x, v))
        if op == "$in":
            return any(same(x, y) for y in _members(op, v))
        if op == "$nin":
            return not _members(op, v) or x is not None and not any(same(x, y) for y in _members(op, v))
        if op == "$prefix":
            return isinstance(x, str) and x.startswith(str(v))
        if op == "$contains":
            return isinstance(x, str) and str(v) in x
        if op == "$exists":
            return (x is not None) == bool(v)
        raise ValueError(f"unknown filter operator: {op}")

    for name, condition in where.items():
        objects = condition.items() if isinstance(condition, Mapping) else [("$eq", condition)]
        if not all(one(metadata.get(name), op, v) for op, v in objects):
            return False
    return True


_SQL = {"$eq": "=", "$ne": "!=", "$gt": ">", "$gte": ">=", "$lt": "<", "$lte": "<="}


def to_sql(where: Mapping[str, object] | None, dialect: str = "json", column: str = "metadata") -> tuple[str, list[object]]:
    """(condition, parameters) for a store reached by JDBC: SQLite's JSON text or Postgres' JSONB. ("", []) for no filter."""
    clauses, params = [], []
    plain = lambda v: int(v) if isinstance(v, bool) else v
    wild = lambda v: re.sub(r"([\\%_])", r"\\\1", str(v))
    for name, condition in (where or {}).items():
        check_field(name)
        ref = f"json_extract({column}, '$.{name}')" if dialect == "json" else f"{column}->>'{name}'"
        for op, v in condition.items() if isinstance(condition, Mapping) else [("$eq", condition)]:
            cast = dialect == "jsonb" and isinstance(v, int | float) and not isinstance(v, bool)
            if op in _SQL:
                clauses.append(f"({ref})::numeric {_SQL[op]} ?" if cast else f"{ref} {_SQL[op]} ?")
                params.append(plain(v))
            elif op in ("$in", "$nin"):
                values = _members(op, v)
                if values:
                    clauses.append(f"{ref} {'IN' if op == '$in' else 'NOT IN'} ({', '.join('?' * len(values))})")
                    params += map(plain, values)
                else:
                    clauses.append("1 = 0" if op == "$in" else "1 = 1")
            elif op in ("$prefix", "$contains"):
                clauses.append(f"{ref} LIKE ? ESCAPE '\\'")
                params.append(("%" if op == "$contains" else "") + wild(v) + "%")
            elif op == "$exists":
                clauses.append(f"{ref} IS {'NOT ' if v else ''}NULL")
            else:
                raise ValueError(f"unknown filter operator: {op}")
    return " AND ".join(clauses), params


def numbered(sql: str, first: int = 1) -> str:
    """Question marks as $first, $first+1, ..."""
    parts = sql.split("?")
    return parts[0] + "".join(f"${first + k}{p}" for k, p in enumerate(parts[1:]))
