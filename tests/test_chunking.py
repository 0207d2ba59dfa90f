"""Chunkers."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from millrace.operators.chunking import SCHEMA, auto_chunker, chunked, code_chunker, cut, markdown_chunker, parts_of, split_text
from millrace.operators.chunking.base import line_of
from millrace.operators.chunking.code import declarations, imports


def test_short_texts_are_one_chunk():
    [c] = split_text("a\nb")
    assert (c.text, c.span, c.lines) == ("a\nb", (0, 3), (1, 2))
    assert split_text("")[0].text == ""


def test_headings_come_first_and_stay_behind():
    text = "# Top\n" + "x" * 50 + "\n## A\n" + "y" * 50 + "\n## B\n" + "z" * 50
    out = split_text(text, 70, 0)
    assert [c.text for c in out] == ["# Top\n" + "x" * 50 + "\n## ", "A\n" + "y" * 50 + "\n## ", "B\n" + "z" * 50]
    assert [c.lines for c in out] == [(1, 3), (3, 5), (5, 6)]


def test_overlap_repeats_the_end():
    text = " ".join(f"word{i}" for i in range(200))
    out = split_text(text, 100, 20)
    assert all(b.text.startswith(a.text[-20:]) for a, b in zip(out, out[1:])) and all(len(c.text) <= 120 for c in out)


@pytest.mark.parametrize("seed", range(12))
def test_spans_find_the_text_and_cover_all(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["\n## ", "\n\n", "\n", " ", "```\n\n", *("abcdefghij" * 3)]) for _ in range(rng.randint(50, 900)))
    for size, overlap in ((40, 0), (100, 30), (60, 59)):
        out = split_text(text, size, overlap)
        assert all(text[c.span[0] : c.span[1]] == c.text for c in out)
        assert all(c.lines == (line_of(text, c.span[0]), line_of(text, c.span[1])) for c in out)
        if overlap == 0:
            assert "".join(c.text for c in out) == text and all(len(c.text) <= size for c in out)


SOURCE = '''import a, { b as c, type D } from './x'
import * as ns from "y";
import 'side'

/** A comment with function fake() {} in it. */
export async function getUser(id: string, opts: { a: number } = {}): Promise<{ x: string }> {
  const inner = `t ${id} }`
  return { x: inner }
}

export class Foo<T> extends Bar<T> implements Baz {
  private name: string = 'x'
  static async run(a: number, b?: string): Promise<void> { if (a) { return } }
  get val() { return 1 }
  constructor(private q: string) { super() }
  arrow = (x: number) => { return x }
}
interface I extends J { a: string }
type U = | 'a' | 'b'
enum E { A, B }
const x: number = 1, y = /re}gex/.test('a')
export const fn = async (a: string) => {
  const z = 3
  return z
}
namespace N { export function q() {} }
'''  # fmt: skip


def test_declarations():
    found = [(d.type, d.name, d.signature) for d in declarations(SOURCE)]
    assert found == [
        ("function", "getUser", "export async function getUser(id: string, opts: { a: number } = {}): Promise<{ x: string }>"),
        ("class", "Foo", "class Foo extends Bar<T> implements Baz"),
        ("interface", "I", "interface I extends J"),
        ("type", "U", "U"), ("enum", "E", "E"), ("variable", "x", "x: number"), ("variable", "y", "y"), ("variable", "fn", "fn"), ("namespace", "N", "N"),
    ]
    by = {d.name: d for d in declarations(SOURCE)}
    assert [(c.type, c.name, c.signature) for c in by["Foo"].children] == [("property", "name", "name"), ("method", "run", "async run(a: number, b?: string): Promise<void>"), ("getter", "val", "val"), ("property", "arrow", "arrow")]
    assert [c.name for c in by["getUser"].children] == ["inner"] and [c.name for c in by["N"].children] == ["q"]
    assert SOURCE[by["fn"].start : by["fn"].end].endswith("return z\n}") and SOURCE[by["E"].start : by["E"].end] == "enum E { A, B }"


def test_imports():
    found, end = imports(SOURCE)
    assert [(i["name"], i["source"], bool(i["is_default"]), bool(i["is_namespace"])) for i in found] == [("a", "./x", True, False), ("c", "./x", False, False), ("D", "./x", False, False), ("ns", "y", False, True), ("side", "side", False, False)]
    assert SOURCE[:end].endswith("'side'")


def test_code_chunks_keep_all_text_and_whole_declarations():
    whole = code_chunker()("const a = 1", "a.ts")
    assert len(whole) == 1 and whole[0].lines == (1, 1) and [e["name"] for e in whole[0].entities] == ["a"]
    out = code_chunker(300)(SOURCE, "a.ts")
    assert len(out) == 3 and [e["name"] for c in out for e in c.entities] == ["getUser", "Foo", "I", "U", "E", "x", "y", "fn", "N"]
    assert "".join("".join(c.text.split()) for c in out) == "".join(SOURCE.split())
    assert out[1].siblings == [{"name": "getUser", "type": "function", "position": "before", "distance": 1}, *({"name": n, "type": t, "position": "after", "distance": k} for k, (n, t) in enumerate([("I", "interface"), ("U", "type"), ("E", "enum")], 1))]
    assert "import" not in code_chunker(300, filter_imports=True)(SOURCE, "a.ts")[0].text
    assert code_chunker(300, overlap_lines=2)(SOURCE, "a.ts")[1].text.startswith("}\n\nexport class Foo")
    assert len(code_chunker(max_tokens=10_000)(SOURCE, "a.ts")) == 1


@pytest.mark.parametrize("seed", range(6))
def test_any_source_is_scanned(seed):
    rng = random.Random(seed)
    bits = ["function f(", ")", "{", "}", "class A", "const x =", "`", "${", "'", '"', "/", "//", "/*", "*/", "\n", " ", "<T>", "=>", "import ", "from 'a'", ";", ",", ":", "@d", "get ", "enum E", "[", "]"]
    for _ in range(300):
        s = "".join(rng.choices(bits, k=rng.randint(1, 40)))
        out = code_chunker(20)(s, "a.ts")
        assert "".join("".join(c.text.split()) for c in out) == "".join(s.split())


def test_routing_and_ids(spark):
    rows = [("a.ts", SOURCE), ("b.md", "para one\n\n" + "w " * 900), ("c.md", "short"), ("d", None)]
    df = spark.createDataFrame(rows, "id string, content string").withColumn("extra", F.lit(7))
    out = chunked(df, auto_chunker(code={"max_chunk_size": 300})).collect()
    by = {r["id"]: r for r in out}
    assert {"a.ts#chunk-0", "a.ts#chunk-2", "b.md#chunk-0", "c.md", "d"} <= by.keys()
    assert by["c.md"]["parent_id"] is None and by["c.md"]["content"] == "short" and by["d"]["content"] is None
    assert by["a.ts#chunk-1"]["parent_id"] == "a.ts" and by["a.ts#chunk-1"]["chunk_index"] == 1 and by["a.ts#chunk-1"]["chunk"]["entities"][0]["name"] == "Foo"
    assert all(r["extra"] == 7 for r in out)
    assert chunked(df.limit(0), markdown_chunker()).collect() == []


def test_scope_chains_run_outwards():
    from millrace.operators.chunking.code import declarations, scope_chain

    decls = declarations("namespace A {\n  class B {\n    run() { return 1 }\n  }\n}\nfunction f() {}\n")
    inner = decls[0].children[0].children[0]
    assert [(d["type"], d["name"]) for d in scope_chain(inner, decls)] == [(decls[0].children[0].type, "B"), (decls[0].type, "A")]
    assert scope_chain(decls[1], decls) == []


def test_batches_are_cut_in_parts():
    assert list(parts_of(pa.array(["aaa", None, "b", "x" * 9, "", "cc", "dd"]), 4)) == [(0, 3), (3, 1), (4, 3)]
    assert list(parts_of(pa.array([], pa.string()))) == []
    texts = [f"# {k}\n" + "word " * 1200 for k in range(3000)]  # 18 MB
    batch = pa.array(texts + [None]), pa.array([*map(str, range(3000)), None])
    kind, chunker = to_arrow_type(T.DataType.fromDDL(SCHEMA)), markdown_chunker()
    tracemalloc.start()
    sizes, seen = [], 0
    for part in cut(iter([batch]), chunker, kind):
        sizes.append(len(part))
        for row in part.slice(0, 3).to_pylist() if seen < 3000 else []:
            assert [c["text"] for c in row] == [c.text for c in chunker(texts[seen], "")]
            break
        seen += len(part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == 3001 and max(sizes) < 200 and peak < 16 << 20
