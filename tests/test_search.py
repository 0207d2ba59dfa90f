"""Keyword search against a full-text engine, vectors and fusion by hand, and the search engine as a whole."""

import json
import random
import sqlite3
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions import identifiers as I
from millrace.operators import bm25, fusion, knn
from millrace.operators.chunking import auto_chunker, markdown_chunker
from millrace.operators.embed import Provider, batch_runs, batch_sizes, hashing
from millrace.operators.rerank import lexical
from millrace.plans.engine import SearchEngine
from millrace.plans.queries import QUERIES
from millrace.streaming.ingest import ingest

WORDS = "user name get login auth token error config parser running runs ponies straße café the of a search index vector".split()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(0)
    rows = [(f"d{i}", " ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 60))), f"# {rng.choice(WORDS)}" if i % 3 == 0 else "") for i in range(120)]
    return rows, spark.createDataFrame(rows, "id string, content string, headers string").cache()


def fts(rows, query, weights="0, 2.0, 1.0"):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(key, heads, body, tokenize='porter unicode61')")
    db.executemany("insert into t values (?, ?, ?)", [(i, h, c) for i, c, h in rows])
    return {i: -s for i, s in db.execute(f"select key, bm25(t, {weights}) from t where t match ?", (query,))}


@pytest.mark.parametrize("query", ["user", "user name", "get_user", "get_user_name token token", "running parser", "Café STRASSE straße", "d7 user", "d1 nothing", "user user user"])
@pytest.mark.parametrize("mode", ["and", "or"])
def test_index_equals_a_full_text_engine(corpus, query, mode):
    rows, df = corpus
    index = bm25.postings(df, "id", ["id", "headers", "content"]).cache()
    dl = bm25.lengths(index)
    n, tokens = dl.agg(F.count("*"), F.sum("dl")).first()
    match = I.match(query, mode)
    got = {r["id"]: r["bm25"] for r in bm25.search(index, n, tokens, match.phrases, match.mode, [0.0, 2.0, 1.0]).collect()}
    want = fts(rows, match.fts())
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], abs=1e-9) for i in got)


def test_scan_equals_index_without_stems(corpus):
    _, df = corpus
    index = bm25.postings(df, "id", ["content"], stemmed=False).cache()
    dl = bm25.lengths(index)
    n, tokens = dl.agg(F.count("*"), F.sum("dl")).first()
    one = {r["id"]: r["bm25"] for r in bm25.search(index, n, tokens, ["user", "token"], "or", stemmed=False).collect()}
    two = {r["id"]: r["bm25"] for r in bm25.scanned(df, "content", ["user", "token"]).collect()}
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k]) for k in one)
    counts = bm25.measured(df, "content", ["user", "token"])
    part = bm25.scanned(df, "content", ["user", "token"], where=F.col("id") < "d3", counts=counts)
    assert all(two[r["id"]] == pytest.approx(r["bm25"]) for r in part.collect())  # the corpus stays whole


def test_only_the_query_terms_are_read(corpus, spark, tmp_path, capsys):
    _, df = corpus
    bm25.postings(df, "id", ["content"]).write.parquet(str(tmp_path / "p"))
    index = spark.read.parquet(str(tmp_path / "p"))
    bm25.search(index, 120, 1000, ["user", "token"]).explain("formatted")
    assert "In(term, [token,user])" in capsys.readouterr().out


def test_vector_kernels_agree(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(50)] + [(50, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    q = rng.normal(size=8).tolist()
    for metric in ("l2", "cosine", "ip"):
        a = {r["id"]: r["distance"] for r in knn.with_distance(df, "v", q, metric).collect()}
        b = {r["id"]: r["distance"] for r in knn.with_distance_arrow(df, "v", q, metric).collect()}
        assert all(a[i] is None and b[i] is None or a[i] == pytest.approx(b[i]) for i in a)
        assert (a[50] is None) == (metric == "cosine")


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_cells_hold_the_nearest(spark, metric):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8)) + 3 * rng.normal(size=(20, 8))[rng.integers(0, 20, 600)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(600, None)], "id long, v array<double>").repartition(3)
    cells = knn.Cells.fit(df, "id", "v", 24, metric)
    listed = knn.Cells.from_json(cells.to_json()).assigned(df, "v").cache()
    ids = np.arange(0, 600, 20)
    exact, found = ({(r["query"], r["id"]) for r in knn.nearest_to_each(listed, "id", "v", ids, x[ids], 10, metric, c).collect()} for c in (None, cells))
    d = knn.distances(x[ids], x, metric)
    d[np.arange(len(ids)), ids] = np.inf
    assert exact == {(int(i), int(j)) for i, row in zip(ids, d) for j in np.argsort(row)[:10]}
    assert cells.probes < 24 and len(found & exact) >= 0.9 * len(exact)
    assert {r["id"] for r in cells.probed(listed, x[3]).collect()} >= {j for i, j in found if i == 3}


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_nearest_of_a_block_in_little_memory(metric):
    rng = np.random.default_rng(4)
    x = np.concatenate((rng.normal(size=(2000, 8)), rng.integers(0, 2, (2000, 8)) + 0.5)).astype(np.float32)  # many ties in the second half
    ids, own = rng.permutation(4000), np.arange(2000)
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(np.arange(0, 8 * 4000 + 1, 8), pa.int32()), pa.array(x.ravel()))], names=["id", "v"])
    q = x[np.argsort(ids)][own].astype(float)
    tracemalloc.start()
    found = pa.Table.from_batches(knn._nearest_in(iter([batch.slice(0, 1500), batch.slice(1500), batch.slice(0, 0)]), own, q, None, 10, metric))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * 8 * knn.TILE < 4000 * 2000 * 8 * 2
    d = np.round(knn.distances(q, x.astype(float), metric), 9)
    d[own[:, None] == ids] = np.inf
    order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :10]
    assert found["query"].to_pylist() == np.repeat(own, 10).tolist()
    assert (found["id"].to_numpy() == ids[order].ravel()).all() and np.allclose(found["distance"].to_numpy(), np.take_along_axis(d, order, 1).ravel(), atol=2e-9)


@pytest.mark.parametrize("most", [0, 100])
def test_frequencies_of_terms(spark, monkeypatch, most):
    monkeypatch.setattr(bm25, "MOST_REPEATED", most)
    rng = random.Random(5)
    rows = [(rng.choice([None, k, k, k, 7, 8]), rng.choice([None, "", " ".join(rng.choices(WORDS, k=rng.randint(1, 9)))])) for k in range(60)]
    for some in (rows, [(k, t) for k, (_, t) in enumerate(rows)], []):
        texts = {}
        for k, t in some:
            texts.setdefault(k, []).extend((t or "").split())
        want = {(w, sum(w in x for x in texts.values()), sum(x.count(w) for x in texts.values())) for w in WORDS} - {(w, 0, 0) for w in WORDS}
        out = bm25.frequencies(spark.createDataFrame(some, "k long, t string"), "k", "t")
        assert {tuple(r) for r in out.collect()} == want and out.dtypes == [("term", "string"), ("df", "bigint"), ("tf", "bigint")]


def test_what_term_df_shuffles_follows_its_words(spark, tmp_path):
    spark.range(0, 3000, 1, 2).selectExpr("id doc_id", "repeat('some words of few kinds ', 20) text").write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["term_df"](spark, str(tmp_path))
    assert {tuple(r) for r in df.collect()} == {(w, 3000, 60_000) for w in "some words of few kinds".split()}
    exchanges = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x]
    assert exchanges and all("hashpartitioning(term#" in x and "doc" not in x for x in exchanges)


def test_postings_are_made_in_parts():
    rng, words = np.random.default_rng(6), np.array([f"w{k}" for k in range(5000)])
    lists = [words[rng.integers(0, 5000, n)].tolist() for n in [*rng.integers(0, 600, 4000), 2 * bm25.TOKENS, 0, 5]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lists))), pa.array(lists, pa.list_(pa.string()))], names=["id", "__0"])
    names = ["term", "id", "field", "tf", "positions", "dl"]
    tracemalloc.start()
    parts, tokens, ids = 0, 0, set()
    for part in bm25.posted(iter([batch, batch.slice(0, 0)]), 1, True, names):
        parts, tokens, ids = parts + 1, tokens + sum(part["tf"].to_pylist()), ids | set(part["id"].to_pylist())
        for r in part.slice(7, 40).to_pylist():
            assert all(bm25.stems([lists[r["id"]][p]]) == [r["term"]] for p in r["positions"]) and (r["tf"], r["dl"]) == (len(r["positions"]), len(lists[r["id"]]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert parts > 5 and tokens == sum(map(len, lists)) and ids == {k for k, x in enumerate(lists) if x}
    assert peak < 2 * bm25.TOKENS * 8 * 25


def test_batch_runs_are_the_batches():
    rng = random.Random(3)
    for _ in range(200):
        lengths = sorted({rng.choice((rng.randint(0, 40), rng.randint(0, 90_000))): rng.choice((1, 3, 70, 500)) for _ in range(rng.randint(0, 9))}.items())
        every, at, want = [k for k, n in lengths for _ in range(n)], 0, []
        for size in batch_sizes(every):
            at += size
            want.append((size, every[at - 1]))
        assert [(size, longest) for times, size, longest in batch_runs(lengths) for _ in range(times)] == want


def lists(spark, *ranked, carry=False):
    out = []
    for k, (weight, ids) in enumerate(ranked):
        rows = [(i, r, None if (r + k) % 2 else f"{i}{k}") for r, i in enumerate(ids)]
        out.append(fusion.ranked(spark.createDataFrame(rows, "id string, o int, content string"), [F.col("o")], k, weight))
    return out


def brute_fusion(*ranked):
    score, first = {}, {}
    for weight, ids in ranked:
        for r, i in enumerate(ids):
            score[i] = score.get(i, 0) + weight / (61 + r)
            first.setdefault(i, len(first))
    return sorted(score, key=lambda i: (-round(score[i], 12), first[i])), score


@pytest.mark.parametrize("ranked", [[(1, "abc"), (1, "bcd")], [(1, "abcdef"), (0.5, "fedcba")], [(1, "ab"), (1, "cd"), (1, "ac")], [(1, "abc")], [(1, ""), (1, "ab")]])
def test_fusion(spark, ranked):
    got = fusion.fused(lists(spark, *ranked), carry=["content"]).orderBy(*fusion.order()).collect()
    order, score = brute_fusion(*ranked)
    assert [r["id"] for r in got] == order and all(r["score"] == pytest.approx(score[r["id"]]) for r in got)
    for r in got:
        values = [None if (ids.index(r["id"]) + k) % 2 else f"{r['id']}{k}" for k, (_, ids) in enumerate(ranked) if r["id"] in ids]
        assert r["content"] == next((v for v in values if v is not None), None)


def test_fan_out_interleaves_categories(spark):
    rows = [("a", "x", 1), ("b", "x", 2), ("c", "x", 3), ("d", "y", 9)]
    df = spark.createDataFrame(rows, "id string, category string, o int")
    out = fusion.fanned_out([fusion.ranked(df, [F.col("o")], 0, by=["category"])], "category").orderBy(F.col("score").desc(), "category")
    assert [r["id"] for r in out.collect()] == ["a", "d", "b", "c"]


# -- the engine

DOCS = [
    ("guide.md", "# Login\nHow users log in with a password.\n\n## Tokens\nTokens expire after an hour.", {"type": "docs", "level": 1}),
    ("auth.ts", "import { a } from './a'\nexport function getUserName(id: string): string {\n  return a(id)\n}\n", {"type": "code", "level": 2}),
    ("notes.md", "Parsing configuration files takes a parser and patience.", {"type": "docs", "level": 3}),
    ("empty.md", "", None),
]


def frame(spark, docs):
    return spark.createDataFrame([(i, c, None if m is None else json.dumps(m)) for i, c, m in docs], "id string, content string, metadata string")


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = SearchEngine(spark, str(tmp_path_factory.mktemp("engine")), embeddings=hashing(32), fields={"level": "int"})
    assert e.index(frame(spark, DOCS)) == 4
    return e


def ids(df):
    return [r["id"] for r in df.orderBy("rank").collect()]


def test_search_ranks_and_shapes(engine):
    rows = engine.search("getUserName", return_content=True).collect()
    assert rows[0]["id"] == "auth.ts" and "getUserName" in rows[0]["content"] and "getusername" in rows[0]["meta"]["highlights"]
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and rows == sorted(rows, key=lambda r: -r["score"])
    plain = engine.search("password login", limit=2).collect()
    assert plain[0]["id"] == "guide.md" and len(plain) == 2 and plain[0]["content"] is None and json.loads(plain[0]["metadata"])["type"] == "docs"
    assert engine.search("password", return_metadata=False).first()["metadata"] is None


def test_search_equals_the_lists_fused_by_hand(engine, spark):
    query = "tokens parser"
    e = engine
    near = knn.with_distance(e.store.read("vectors"), "embedding", hashing(32).make()([query])[0]).orderBy(F.round("distance", 9), "id").select("id").collect()
    docs = [(i, c, "") for i, c, _ in DOCS]
    meta = {i: json.dumps(m) if m else "" for i, _, m in DOCS}
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(key, heads, body, extra, tokenize='porter unicode61')")
    heads = {"guide.md": "Login\nTokens"}
    db.executemany("insert into t values (?, ?, ?, ?)", [(i, heads.get(i, ""), c, meta[i]) for i, c, _ in docs])
    word = lambda m: [r[0] for r in db.execute("select key from t where t match ? order by round(bm25(t, 0, 2.0, 1.0, 0), 9), key", (m,))]
    order, score = brute_fusion((1, word('"tokens" "parser"')), (0.5, word('"tokens" OR "parser"')), (1, [r["id"] for r in near]))
    got = e.search(query).collect()
    assert [r["id"] for r in got] == order and all(r["score"] == pytest.approx(score[r["id"]]) for r in got)


@pytest.mark.parametrize(("where", "want"), [({"type": "code"}, {"auth.ts"}), ({"level": {"$gte": 2}}, {"auth.ts", "notes.md"}), ({"type": {"$exists": False}}, {"empty.md"}), ({"type": {"$in": []}}, set()), ({"type": "docs", "level": {"$lt": 3}}, {"guide.md"})])
def test_filters_come_before_the_limit(engine, where, want):
    assert set(ids(engine.search("user tokens parser", where=where, limit=3))) == want


def test_queries_without_words_search_vectors_alone(engine):
    assert len(ids(engine.search("?!"))) == 4


def test_modes(spark, tmp_path):
    for mode, metric in (("keyword", "l2"), ("vector", "l2"), ("vector", "cosine"), ("vector", "ip"), ("composed", "l2")):
        e = SearchEngine(spark, str(tmp_path / f"{mode}{metric}"), mode=mode, embeddings=None if mode == "keyword" else hashing(32), metric=metric)
        assert e.search("user").count() == 0
        e.index(frame(spark, DOCS))
        rows = e.search("parser patience").collect()
        assert rows[0]["id"] == "notes.md" and all(r["score"] is None and r["id"] == "empty.md" or 0 <= r["score"] <= 1 for r in rows)
        one = e.search("parser").collect()
        assert one[0]["id"] == "notes.md" or (mode, metric) == ("vector", "l2")  # a vector of zeros lies nearer than most
        if mode == "keyword":
            assert len(one) == 1 and 0 < one[0]["score"] < 1 and e.search("absent").count() == 0 and e.search(" ? ").count() == 0
            assert ids(e.search("notes"))[0] == "notes.md"  # ids are searched in this mode
    with pytest.raises(ValueError, match="embeddings are required"):
        SearchEngine(spark, str(tmp_path / "x"))
    with pytest.raises(ValueError, match="mode must be"):
        SearchEngine(spark, str(tmp_path / "x"), mode="other")


def test_upserts_removals_and_compaction(spark, tmp_path):
    e = SearchEngine(spark, str(tmp_path / "e"), embeddings=hashing(16), chunker=auto_chunker(markdown={"size": 60, "overlap": 10}))
    n = e.index(frame(spark, DOCS))
    assert n > 4
    assert sorted(ids_of(e)) == sorted(i for i, *_ in DOCS)
    before = {r["id"] for r in e.store.read("chunks").where("doc = 'guide.md'").collect()}
    assert len(before) > 1 and all(i.startswith("guide.md#chunk-") for i in before)
    hit = e.search("expire", limit=1, return_content=True).first()
    assert hit["chunk"]["parent_id"] == "guide.md" and "expire" in hit["content"]
    assert e.index(frame(spark, [("guide.md", "Short now.", None)])) == 1  # fewer chunks: none of the old stay
    assert e.store.read("chunks").where("doc = 'guide.md'").count() == 1
    assert "guide.md" not in ids(e.search("password", limit=1)) or e.search("password", limit=1).first()["chunk"] is None
    assert e.remove(["notes.md", "unknown"]) == 2
    assert sorted(ids_of(e)) == ["auth.ts", "empty.md", "guide.md"]
    one = [tuple(r) for r in e.search("short user name").select("id", F.round("score", 9)).collect()]
    e.compact()
    assert len(e.store.segments()) == 1
    assert [tuple(r) for r in e.search("short user name").select("id", F.round("score", 9)).collect()] == one
    e.index(frame(spark, [("new.md", "Short text.", None)]))
    assert "new.md" in ids_of(e)
    e.clear()
    assert ids_of(e) == [] and e.search("short").count() == 0
    e.index(frame(spark, [("again.md", "Short text.", None)]))
    assert ids_of(e) == ["again.md"]
    e.close()


def ids_of(e):
    return [r["id"] for r in e.list_ids().collect()]


def test_categories_are_balanced(spark, tmp_path):
    docs = [("code.ts", "parser token", {"k": 1}), *((f"d{i}.md", "parser token parser token search", None) for i in range(5))]
    kind = F.when(F.col("id").endswith(".ts"), "code").otherwise("docs")
    e = SearchEngine(spark, str(tmp_path / "c"), mode="keyword", categorize=kind)
    e.index(frame(spark, docs))
    rows = e.search("parser token", limit=4).collect()
    assert rows[0]["id"] == "code.ts" and [r["id"] for r in rows[1:]] == ["d0.md", "d1.md", "d2.md"]
    assert json.loads(rows[0]["metadata"]) == {"k": 1, "category": "code"} and json.loads(rows[1]["metadata"]) == {"category": "docs"}
    assert set(ids(e.search("parser", where={"category": "code"}))) == {"code.ts"}
    again = SearchEngine(spark, str(tmp_path / "c"), mode="keyword", categorize=kind)  # categories are read from the store
    assert ids(again.search("parser token", limit=1)) == ["code.ts"]


def test_a_category_replaces_the_metadata_key(spark, tmp_path):
    docs = [("1", "hello", {"a": 1, "category": "old", "deep": {"x": [1, "b"]}}), ("2", "hello", {"a": 1}), ("3", "hello", None)]
    e = SearchEngine(spark, str(tmp_path / "k"), mode="keyword", categorize=F.lit('ne"w'))
    e.index(frame(spark, docs))
    assert set(ids(e.search("hello", where={"a": 1}))) == {"1", "2"}
    assert {r["id"]: json.loads(r["metadata"]) for r in e.search("hello").collect()} == {"1": {"a": 1, "category": 'ne"w', "deep": {"x": [1, "b"]}}, "2": {"a": 1, "category": 'ne"w'}, "3": {"category": 'ne"w'}}


def test_a_write_that_is_cut_off_changes_nothing(spark, tmp_path, monkeypatch):
    e = SearchEngine(spark, str(tmp_path / "m"), mode="keyword")
    e.index(frame(spark, DOCS))
    held = e.search("parser")  # planned before what follows
    real = e.store._write_manifest

    def cut(number, manifest):
        (tmp_path / "m" / "_new-cut").write_text("half a mani")
        raise KeyboardInterrupt

    monkeypatch.setattr(e.store, "_write_manifest", cut)
    with pytest.raises(KeyboardInterrupt):
        e.remove(["notes.md"])
    monkeypatch.setattr(e.store, "_write_manifest", real)
    again = SearchEngine(spark, str(tmp_path / "m"), mode="keyword")
    assert ids(again.search("parser")) == ["notes.md"]
    again.index(frame(spark, [("new.md", "parser", None)]))
    again.compact()
    assert ids(held) == ["notes.md"] and set(ids(again.search("parser"))) == {"notes.md", "new.md"}  # its segment is still there
    again.store.keep = 0.0
    again.remove(["new.md"])
    again.remove(["unknown"])
    assert len([p for p in (tmp_path / "m").iterdir() if p.name.startswith("s-")]) == len(again.store.segments()) == 3
    assert len([p for p in (tmp_path / "m").iterdir() if p.name.startswith("MANIFEST")]) == 1


def test_a_search_reads_few_cells(spark, tmp_path, capsys):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(40, 6)) * 4
    vectors = {f"v{i}": (centers[i % 40] + rng.normal(size=6)).tolist() for i in range(800)}
    model = Provider(lambda: lambda texts: [vectors[t] for t in texts], 6)
    exact, near = (SearchEngine(spark, str(tmp_path / f"c{k}"), mode="vector", embeddings=model, cells=k) for k in (None, 40))
    for e in (exact, near):
        e.index(frame(spark, [(i, i, {"n": int(i[1:])}) for i in vectors]))
    asked = list(vectors)[::50]
    both = sum(len(set(ids(near.search(q))) & set(ids(exact.search(q)))) for q in asked)
    assert both >= 0.9 * 10 * len(asked) and near.store.get("CELLS")
    assert ids(near.search("v3", where={"n": {"$lt": 9}})) == ids(exact.search("v3", where={"n": {"$lt": 9}}))
    capsys.readouterr()
    near.search("v3").explain("formatted")
    assert "cell" in capsys.readouterr().out.split("PushedFilters")[1]
    near.clear()
    assert near.store.get("CELLS") is None and near.search("v3").count() == 0


def test_reranking_fetches_more_and_hides_content(spark, tmp_path):
    seen = []

    def reversed_(query, df):
        seen.append((query, df.count(), df.where("content is not null").count()))
        return lexical()(query, df)

    e = SearchEngine(spark, str(tmp_path / "r"), mode="keyword", reranker=reversed_)
    e.index(frame(spark, [(f"d{i}", "parser " * (i + 1) + "other words here", None) for i in range(9)]))
    rows = e.search("parser", limit=2).collect()
    assert seen == [("parser", 6, 6)] and len(rows) == 2 and all(r["content"] is None for r in rows)
    assert rows[0]["score"] >= rows[1]["score"]


def test_wrong_widths_are_errors(spark, tmp_path):
    bad = Provider(lambda: lambda texts: [[1.0, 2.0] for _ in texts], 3)
    with pytest.raises(Exception, match="expected 3 dimensions"):
        SearchEngine(spark, str(tmp_path / "w"), embeddings=bad).index(frame(spark, DOCS))


def test_streams_are_indexed(spark, tmp_path):
    source = tmp_path / "in"
    e = SearchEngine(spark, str(tmp_path / "s"), mode="keyword", chunker=markdown_chunker())
    for k in range(2):
        frame(spark, [(f"s{k}", f"streamed parser {k}", None)]).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("id string, content string, metadata string").parquet(str(source))
        query = ingest(stream, e, str(tmp_path / "checkpoint"), once=True, compact_every=2)
        query.awaitTermination()
    assert sorted(ids_of(e)) == ["s0", "s1"] and len(e.store.segments()) == 1
    assert set(ids(e.search("parser"))) == {"s0", "s1"}


def test_progress_is_told(spark):
    told = []
    docs = frame(spark, DOCS * 1).repartition(4)
    SearchEngine(spark, embeddings=hashing(8), chunker=auto_chunker(), progress=lambda *a: told.append(a)).index(docs)
    phases = list(dict.fromkeys(t[0] for t in told))
    assert phases == ["chunking", "embedding", "storing"]
    for phase in phases:
        steps = [t[1:] for t in told if t[0] == phase]
        assert steps[0] == (0, 4) and steps[-1] == (4, 4) and steps == sorted(steps) and len(set(steps)) == len(steps)


def test_tasks_that_end_are_told(spark):
    told = []
    e = SearchEngine(spark, mode="keyword", progress=lambda *a: told.append(a))
    with e._told("chunking", 10) as done:
        for _ in range(2):
            spark.sparkContext.parallelize(range(3), 1).foreach(lambda _: done.add(1))
            time.sleep(0.6)
    assert told == [("chunking", 0, 10), ("chunking", 3, 10), ("chunking", 6, 10), ("chunking", 10, 10)]
