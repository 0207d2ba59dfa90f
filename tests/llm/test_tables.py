"""Operators over whole tables, against brute force."""

import os
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import graphs, mixing, multi_index, packing, quality, sharding, simhash, spotsigs
from millrace.llm.queries import QUERIES, tokenizer_path

TOKENIZER = tokenizer_path()


def roots(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# -- graphs


def test_forest_keeps_components():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 60, (2, rng.integers(1, 80)))
        x, y = graphs.forest(a, b)
        nodes = range(60)
        assert roots(nodes, zip(a.tolist(), b.tolist(), strict=True)) == roots(nodes, zip(x.tolist(), y.tolist(), strict=True))
        assert len(set(x.tolist())) == len(x)


@pytest.mark.parametrize("one_task", [0, 1_000_000])
def test_components_of_long_and_wide_graphs(spark, monkeypatch, one_task):
    monkeypatch.setattr(graphs, "ONE_TASK", one_task)
    chain = [(k, k + 1) for k in range(1000, 1060)]
    star = [(5, k) for k in range(2000, 2050)]
    rng = random.Random(1)
    messy = [(rng.randint(1, 300) * 10**12 - 10**14, rng.randint(1, 300) * 10**12 - 10**14) for _ in range(200)]
    links = [(a, b) for a, b in chain + star + messy if a != b]
    rows = spark.createDataFrame([(a, b, 0) for a, b in links], graphs.REDUCED)
    got = {r["node"]: r["root"] for r in graphs.components(rows).collect()}
    nodes = {n for link in links for n in link}
    want = roots(nodes, links)
    assert all(got.get(n, n) == want[n] for n in nodes)
    assert graphs.components(spark.createDataFrame([], graphs.REDUCED)).collect() == []


def test_reduced_counts_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(graphs, "FLUSH", 7)
    rng = random.Random(2)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(120)}
    weight = {n: n % 3 + 1 for n in range(40)}
    batches = list(graphs.Reducer().add(*(np.array(c) for c in zip(*((a, b, weight[b], weight[a]) for a, b in pairs), strict=True))))
    reducer = graphs.Reducer()
    batches = [*reducer.add(*(np.array(c) for c in zip(*((a, b, weight[b], weight[a]) for a, b in pairs), strict=True))), *reducer.end()]
    rows = [tuple(r.values()) for b in batches for r in b.to_pylist()]
    counts = Counter()
    for a, b in pairs:
        counts[a] += weight[b]
        counts[b] += weight[a]
    got = Counter()
    for node, other, n in rows:
        if node == other:
            got[node] += n
    assert got == counts
    assert roots(range(40), pairs) == roots(range(40), [(a, b) for a, b, _ in rows if a != b])


# -- sharding


def check_shards(rows, shards, total):
    assert len(rows) == total
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by.get(k, [])) for k in range(shards)]
    assert sum(sizes) == total and max(sizes) - min(sizes) <= 1


def test_shards_have_all_rows_and_like_sizes(messy, clashing, empty):
    out = sharding.shuffled(messy, 4, seed=3).collect()
    check_shards(out, 4, messy.count())
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((r["doc_id"], r["text"]) for r in messy.collect())
    wide = sharding.shuffled(clashing, 40, seed=3)
    assert sorted(wide.columns) == sorted(clashing.columns)
    check_shards(wide.collect(), 40, messy.count())
    assert sharding.shuffled(empty, 4).collect() == []


def test_shards_depend_on_seed_alone(messy):
    one = sorted(map(repr, sharding.shuffled(messy, 4, seed=3).select("doc_id", "text", "shard", "slot").collect()))
    two = sorted(map(repr, sharding.shuffled(messy.repartition(7), 4, seed=3).select("doc_id", "text", "shard", "slot").collect()))
    other = sorted(map(repr, sharding.shuffled(messy, 4, seed=4).select("doc_id", "text", "shard", "slot").collect()))
    assert one == two != other


def test_repeated_records_spread_over_buckets(spark):
    df = spark.range(600).select(F.when(F.col("id") < 300, F.lit(-1)).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    out = sharding.shuffled(df, 7, bucket_bytes=500).collect()
    check_shards(out, 7, 600)
    per = Counter(r["shard"] for r in out if r["doc_id"] == -1)
    assert sum(per.values()) == 300 and min(per.values()) > 20
    assert Counter(r["doc_id"] for r in out if r["doc_id"] != -1) == Counter(range(300, 600))


def test_repeated_long_records_spread_over_buckets(spark):
    rows = [(7, "x" * 50_000)] * 40 + [(k, f"text {k}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    cut = sharding.shuffled(df, 5, seed=1, bucket_bytes=400_000)
    assert Counter((r["doc_id"], r["text"]) for r in cut.collect()) == Counter(rows)
    held = [n for n in cut.groupBy(F.spark_partition_id()).agg(F.sum(F.length("text")).alias("n")).toPandas()["n"]]
    assert len(held) >= 5 and max(held) <= 3 * sum(held) / len(held)


def test_fisher_yates_is_a_fair_permutation():
    seen = Counter(tuple(sharding.fisher_yates(3, seed, 0).tolist()) for seed in range(6000))
    assert len(seen) == 6 and min(seen.values()) > 850


def test_write_shards(messy, tmp_path):
    sharding.write_shards(messy, str(tmp_path / "out"), 3)
    back = messy.sparkSession.read.parquet(str(tmp_path / "out"))
    check_shards(back.collect(), 3, messy.count())


def test_sharding_query(spark, sf):
    rows = QUERIES["op1_sharding"](spark, sf).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check_shards(rows, 40, len(texts))
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows)


# -- quality


def test_rules_find_a_conjunction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 12))
    y = ((x[:, 3] > 0.5) & (x[:, 7] <= 0.3)).astype(float)
    model = quality.fit_arrays(x, y)
    assert ((model.scores(x) > 0.5) == (y > 0)).mean() > 0.99
    assert len(model.rules) < len(quality.tree_rules(x, y))  # the lasso drops rules
    again = quality.RuleEnsemble.from_json(model.to_json())
    assert np.allclose(again.scores(x), model.scores(x))


def test_lasso_at_a_large_penalty_keeps_nothing():
    rng = np.random.default_rng(1)
    z = (rng.random((500, 6)) > 0.5).astype(float)
    w, b = quality.lasso_logistic(z, z[:, 0], 10.0)
    assert not w.any() and abs(1 / (1 + np.exp(-b)) - z[:, 0].mean()) < 1e-3


def test_column_and_array_scores_agree(messy):
    stats = quality.with_statistics(messy, "text").select(*("s_" + s for s in quality.STATS))
    x = np.array([list(r) for r in stats.collect()])
    assert np.isfinite(x).all()
    model = quality.fit_arrays(np.vstack((x, x + 0.1)), np.array([1.0, 0.0] * len(x)))
    got = [r["score"] for r in quality.scored(messy, model).collect()]
    assert np.allclose(sorted(got), sorted(model.scores(x)))


def test_statistics_by_hand(spark):
    df = spark.createDataFrame([("Aa Aa b1 | !\nx x\nx x",)], "text string")
    s = quality.with_statistics(df, "text").first()
    assert s["s_repeats"] == pytest.approx(4 / 9) and s["s_distinct"] == pytest.approx(5 / 9)
    assert s["s_upper"] == pytest.approx(2 / 20) and s["s_bars"] == pytest.approx(1 / 9)
    assert s["s_symbols"] == pytest.approx(2 / 20) and s["s_same_lines"] == pytest.approx(1 / 3)


def test_scores_of_any_table(spark, messy, clashing, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (None, 1), (6, 1), (7, 0)], "doc_id long, quality int")
    model = quality.fit(messy, labels)
    out = quality.scored(clashing, model)
    assert out.columns.count("score") == 1 and out.count() == messy.count()
    assert all(0 <= r["score"] <= 1 for r in out.collect())
    for nothing in (quality.fit(empty, labels), quality.fit(messy, labels.limit(0))):
        assert [r["score"] for r in quality.scored(messy, nothing).select("score").distinct().collect()] == [0.5]
    assert quality.scored(empty, model).count() == 0


def test_quality_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in QUERIES["op2_quality"](spark, sf).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for i, r in rows.items())
    held = [(rows[r["doc_id"]]["predicted"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r["doc_id"]]["held_out"]]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) >= 0.95
    assert all(p == 1 for p, q in held if q == 1)


# -- embeddings


def cosine_links(vectors, threshold=0.9):
    x = np.array(vectors, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    return [(i, j) for i in range(len(x)) for j in range(i) if near[i, j]]


def near_vectors(rng, groups, each, width=16, noise=0.08):
    out = []
    for _ in range(groups):
        c = rng.normal(size=width)
        out += [(c / np.linalg.norm(c) + rng.normal(size=width) * noise / np.sqrt(width)) * rng.uniform(0.1, 9) for _ in range(rng.integers(1, each))]
    return out


def test_multi_sequence_order_equals_a_full_sort():
    rng = np.random.default_rng(3)
    grid = multi_index.Grid(rng.normal(size=(9, 4)), rng.normal(size=(7, 3)))
    x = rng.normal(size=(50, 7))
    a, b = grid.halves(x)
    for cells in (1, 5, 20, 63, 100):
        visits = grid.visits(x, cells)
        for k in range(len(x)):
            sums = (a[k][:, None] + b[k][None, :]).ravel()
            assert np.allclose(np.sort(sums)[: visits.shape[1]], sums[visits[k]])
            assert (grid.ranks(a[k], b[k], visits[k]) == np.arange(visits.shape[1])).all()
    assert (grid.visits(x, 1)[:, 0] == grid.home(x)).all()


def test_links_equal_brute_force(spark, monkeypatch):
    for name, value in (("RESIDENTS", 15), ("VISITORS", 20), ("BLOCK", 4), ("CELL", 4)):
        monkeypatch.setattr(multi_index, name, value)
    rng = np.random.default_rng(4)
    v = near_vectors(rng, 40, 9)
    df = spark.createDataFrame([(i * 3, [float(z) for z in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    links = cosine_links(v)
    n = Counter(k for pair in links for k in pair)
    want = roots(range(len(v)), links)
    rows = {r["vec_id"]: r for r in multi_index.near_duplicates(df).collect()}
    found = sum(rows[i * 3]["n_links"] for i in range(len(v)))
    assert found >= 0.9 * sum(n.values())
    assert all(rows[i * 3]["n_links"] <= n[i] for i in range(len(v)))
    assert len([i for i in range(len(v)) if rows[i * 3]["n_links"] == n[i]]) >= 0.9 * len(v)
    for i in range(len(v)):  # components are those of links that were found: never beyond the true ones, and kept says which is first
        c = rows[i * 3]["component_id"]
        assert c % 3 == 0 and want[c // 3] == want[i] and c <= i * 3 and rows[i * 3]["kept"] == (c == i * 3) and rows[c]["kept"]
    monkeypatch.setattr(multi_index, "calibrated", lambda _, grid, *__: len(grid.first) * len(grid.second))  # every cell
    whole = {r["vec_id"]: r for r in multi_index.near_duplicates(df).collect()}
    assert all((whole[i * 3]["n_links"], whole[i * 3]["component_id"], whole[i * 3]["kept"]) == (n[i], want[i] * 3, want[i] == i) for i in range(len(v)))


@pytest.mark.parametrize("small", [4_096, 30, 1])
def test_vectors_of_every_length_are_linked(spark, monkeypatch, small):
    for name, value in (("SMALL", small), ("BLOCK", 7), ("FEW", 2)):
        monkeypatch.setattr(multi_index, name, value)
    monkeypatch.setattr(multi_index.compared, "__defaults__", (9,))
    monkeypatch.setattr(multi_index, "calibrated", lambda _, grid, *__: len(grid.first) * len(grid.second))
    rng = np.random.default_rng(6)
    rows, links = [], []
    for width, groups in ((3, 20), (5, 12), (2, 9), (1, 1), (8, 14)):
        v = near_vectors(rng, groups, 5, width)
        links += [(a + len(rows), b + len(rows)) for a, b in cosine_links(v)]
        rows += [x.tolist() for x in v]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>").repartition(3)
    n, want = Counter(k for pair in links for k in pair), roots(range(len(rows)), links)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in multi_index.near_duplicates(df).collect()}
    assert got == {i: (n[i], want[i]) for i in range(len(rows))}


@pytest.mark.parametrize("most", [0, 10])
def test_joins_of_hot_keys_have_all_rows(spark, most):
    rows = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(200)], "key int, x int")
    table = rows.groupBy("key").agg(F.count("*").alias("n")).withColumn("y", F.col("key") * 2)
    got = Counter((r["key"], r["x"], r["y"]) for r in graphs.joined(rows, table, ["key"], least=most).collect())
    assert got == Counter((r["key"], r["x"], r["key"] * 2) for r in rows.collect())


def test_vectors_of_any_kind(spark, empty):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (10, [1e-30, 0.0]), (11, [1e30, 0.0]), (12, [0.0, 1.0]), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit(1)).withColumn("v", F.lit("x"))
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in multi_index.near_duplicates(df).collect()), key=str)
    want = [(1, 5, 1, True), (1, 5, 1, True), (2, 5, 1, False), (None, 5, 1, False), (10, 5, 1, False), (11, 5, 1, False), (12, 0, 12, True)]
    want += [(k, 0, k, True) for k in (3, 4, 5, 6, 7, 8, 9)] + [(None, 0, None, False)]
    assert got == sorted(want, key=str)
    assert multi_index.near_duplicates(df.limit(0)).collect() == []
    line = spark.createDataFrame([(1, [2.0]), (2, [3.0]), (3, [-1.0])], "vec_id long, embedding array<double>")
    assert sorted((r["vec_id"], r["n_links"]) for r in multi_index.near_duplicates(line).collect()) == [(1, 1), (2, 1), (3, 0)]


def test_recall_of_every_fiftieth_vector(spark):
    sf = next(p for p in ("/root/testdata/check_s", "/root/testdata/sf0.1") if os.path.exists(p))
    rows = {r["vec_id"]: r["n_links"] for r in QUERIES["op3_multi_index"](spark, sf).collect()}
    x = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids = sorted(x)
    m = np.array([x[i] for i in ids], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    asked = [k for k, i in enumerate(ids) if i % 50 == 0]
    true = (m[asked] @ m.T >= 0.9).sum(axis=1) - 1
    found = np.array([rows[ids[k]] for k in asked])
    assert (found <= true).all() and true.sum() > 20 and found.sum() >= 0.9 * true.sum()


@pytest.mark.parametrize("most", [65_536, 2_048])
def test_rare_links_are_found(spark, monkeypatch, most):
    monkeypatch.setattr(multi_index, "MOST_PROBES", most, raising=False)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.normal(size=(60, 32))
    away -= (away * x[:60]).sum(axis=1, keepdims=True) * x[:60]
    x[60:120] = 0.91 * x[:60] + np.sqrt(1 - 0.91**2) * away / np.linalg.norm(away, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(3)
    true = (x @ x.T >= 0.9).sum(axis=1) - 1
    rows = {r["vec_id"]: r["n_links"] for r in multi_index.near_duplicates(df).collect()}
    found = np.array([rows[i] for i in range(len(x))])
    assert (found <= true).all() and found.sum() >= 0.98 * true.sum()


# -- simhash


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 2]) for i in range(len(words) - 1)] or [words[0]]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprints_by_definition(messy):
    for r in messy.collect():
        if r["text"] is None or len(r["text"]) < 5000:
            assert simhash.fingerprint(r["text"]) & (1 << 64) - 1 == slow_fingerprint(r["text"])
    assert simhash.fingerprint("A É\x85ß  b") & (1 << 64) - 1 == slow_fingerprint("A É\x85ß  b")


@pytest.mark.parametrize("classes", [1, 10, 10**5, 10**7, 10**10, 10**13])
@pytest.mark.parametrize("radius", [0, 1, 3, 6, 9])
def test_segments_miss_no_pair(classes, radius):
    parts = simhash.segments(classes, radius)
    assert sum(n for _, n, _ in parts) == 64 and sum(r + 1 for _, _, r in parts) == radius + 1
    rng = random.Random(classes + radius)
    for _ in range(300):
        d = sum(1 << b for b in rng.sample(range(64), radius))
        assert any((d >> s & (1 << n) - 1).bit_count() <= r for s, n, r in parts)
    if radius == 6:
        assert all(len(simhash.ball(n, r)) < 6000 for _, n, r in parts)
        assert len(parts) == {1: 4, 10: 4, 10**5: 4, 10**7: 4, 10**10: 2, 10**13: 2}[classes]


@pytest.mark.parametrize(("hot", "classes"), [(4096, None), (3, None), (4096, 10**8), (3, 10**10)])
def test_pairs_equal_brute_force(spark, monkeypatch, hot, classes):
    rng = random.Random(7)
    fps = [0, -1]
    for _ in range(25):
        c = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            x = c
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            fps.append(x - (1 << 64) if x >> 63 else x)
    fps = list(dict.fromkeys(fps))
    if classes:
        real = simhash.segments
        monkeypatch.setattr(simhash, "segments", lambda n, r: real(classes, r))
    df = spark.createDataFrame([(f, 1) for f in fps], "fp long, n long")
    got = [(r["a"], r["b"]) for r in simhash.near_pairs(df, 6, hot).collect()]
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 6}
    assert len(got) == len(set(got)) and set(got) == want


def brute_near(rows, radius=6):
    f = [simhash.fingerprint(t) for _, t in rows]
    near = [[j for j in range(len(rows)) if j != i and ((f[i] ^ f[j]) & (1 << 64) - 1).bit_count() <= radius] for i in range(len(rows))]
    root = roots(range(len(rows)), [(i, j) for i, js in enumerate(near) for j in js])
    least = {}
    for i, r in root.items():
        if rows[i][0] is not None:
            least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    return sorted(((rows[i][0], f[i], len(near[i]), least.get(root[i])) for i in range(len(rows))), key=str)


def test_near_duplicates_equal_brute_force(messy, clashing, empty):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    for df in (messy, clashing):
        got = sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=str)
        assert got == brute_near(rows)
    assert simhash.near_duplicates(empty).collect() == []


def test_one_document_of_each_group_stays(messy, clashing, empty):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    f = [simhash.fingerprint(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if ((f[i] ^ f[j]) & (1 << 64) - 1).bit_count() <= 6]
    groups = defaultdict(list)
    for i, r in roots(range(len(rows)), near).items():
        groups[r].append(rows[i][0])
    out = simhash.drop_near_duplicates(clashing)
    assert out.columns == clashing.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(min((i for i in ids if i is not None), default=None) for ids in groups.values())
    assert simhash.drop_near_duplicates(empty).collect() == []


def test_simhash_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(((r["doc_id"], r["fingerprint"], r["n_near"], r["component_id"]) for r in QUERIES["op4_simhash"](spark, sf).collect()), key=str)
    assert got == sorted(((i, f"{f & (1 << 64) - 1:016x}", n, c) for i, f, n, c in brute_near(docs)), key=str)


# -- spotsigs


def test_signatures_by_hand():
    s = spotsigs.signatures("The quick brown fox and the lazy dog.")
    assert s == {"the quick brown", "and lazy dog", "the lazy dog"}
    assert spotsigs.signatures("alpha beta gamma delta") == {"alpha beta gamma", "beta gamma delta"}
    assert spotsigs.signatures("Word") == {"word"} and spotsigs.signatures("!?") == {"!?"} and spotsigs.signatures(None) == frozenset()
    assert spotsigs.jaccard(frozenset(), frozenset()) == 1.0 and spotsigs.jaccard(frozenset("a"), frozenset()) == 0.0


def brute_spots(rows):
    def near(a, b):
        x = len(a & b) / len(a | b) if a | b else 1.0
        return x if x >= spotsigs.LEAST else 0.0

    def signed(t):
        h = xxhash.xxh64_intdigest((t or "").encode(), 42)
        return h - (1 << 64) if h >> 63 else h

    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, signed(r[1])))
    out = []
    for k, (i, t) in enumerate(ordered):
        t, following = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + following[:half]
        a, b, c = map(spotsigs.signatures, (t, e, following))
        out.append((i, len(t), sha256(e.encode()).hexdigest(), spotsigs.digest(a), spotsigs.digest(b), near(a, b), near(a, c), len(a)))
    return sorted(out, key=str)


@pytest.mark.parametrize("part_size", [None, 2000])
def test_spot_fingerprints_equal_brute_force(messy, clashing, empty, part_size):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    for df in (messy, clashing):
        assert sorted((tuple(r) for r in spotsigs.fingerprints(df, part_size=part_size).collect()), key=str) == brute_spots(rows)
    assert spotsigs.fingerprints(empty).collect() == []


@pytest.mark.parametrize("kind", ["string", "int", "date", "decimal(10,2)"])
def test_spot_ids_of_any_type(spark, kind):
    rng = random.Random(13)
    rows = [(f"200{k % 10}-01-{10 + k % 19}" if kind == "date" else str(k * 7 % 50), f"the {rng.choice('abcd')} of {rng.choice('efgh')} and some more words {k}") for k in range(300)]
    df = spark.createDataFrame([*rows, (None, "x")], "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast(kind)).repartition(3)
    out = spotsigs.fingerprints(df, part_size=3000)
    assert out.schema["doc_id"].dataType == df.schema["doc_id"].dataType
    if kind == "string":
        assert sorted((tuple(r) for r in out.collect()), key=str) == brute_spots([*rows, (None, "x")])
    want = Counter((r["doc_id"], spotsigs.digest(spotsigs.signatures(r["text"]))) for r in df.collect())
    assert Counter((r["doc_id"], r["fingerprint"]) for r in out.collect()) == want


def test_ranges_prune_without_effect_on_likeness():
    rng = random.Random(2)
    for t in (0.05, 0.3, 0.6):
        ranges = spotsigs.Ranges(t)
        for _ in range(800):
            a, b = (frozenset(rng.sample(range(120), rng.randint(0, rng.choice((3, 30, 120))))) for _ in range(2))
            x = len(a & b) / len(a | b) if a | b else 1.0
            assert ranges.likeness(a, b) == pytest.approx(x if x >= t else 0.0)


def test_spot_parts_split_an_id_that_many_rows_have(spark):
    rows = [(5, f"the {k} stone river and tree {k} hill") for k in range(150)] + [(5, "the same and same again")] * 120 + [(k, f"of word{k} with bird{k}") for k in range(-5, 12)] + [(None, "the null one")] * 90
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in spotsigs.fingerprints(df, part_size=1500).collect()), key=str)
    assert got == brute_spots(rows)


def test_spot_pairs_equal_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for g in range(12):
        words = [f"w{g}x{k}" for k in range(rng.randint(40, 160))]
        for _ in range(rng.randint(1, 5)):
            mine = [w for w in words if rng.random() > 0.01]
            rows.append((len(rows), " ".join(f"the {w}" if k % 3 == 0 else w for k, w in enumerate(mine))))
    rows += [(len(rows), rows[0][1]), (len(rows) + 1, None), (len(rows) + 2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    members, pairs = spotsigs.similar_pairs(df, threshold=0.6)
    ids = defaultdict(list)
    for r in members.collect():
        ids[r["set_id"]].append(r["doc_id"])
    got = {(min(i, j), max(i, j)): r["likeness"] for r in pairs.collect() for i in ids[r["a"]] for j in ids[r["b"]]}
    got |= {(i, j): 1.0 for same in ids.values() for i in same for j in same if i < j}
    sets = [spotsigs.signatures(t) for _, t in rows]
    want = {(i, j): spotsigs.jaccard(sets[i], sets[j]) for i in range(len(rows)) for j in range(i + 1, len(rows)) if spotsigs.jaccard(sets[i], sets[j]) >= 0.6}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got) and len(want) > 4


def test_size_ranges_hold_all_matches():
    for t in (0.3, 0.5, 0.6, 0.9, 1.0):
        starts = spotsigs.size_ranges(500, t)
        part = lambda n, s=starts: sum(n >= x for x in s[1:])
        assert all(part(q) - part(p) <= 1 for q in range(1, 400) for p in range(1, q + 1) if p / q >= t)


# -- packing


def check_packing(rows, documents, capacity=1024):
    library = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for i, t in documents:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids), capacity)):
            want[i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_cuts():
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_plans_hold_the_histogram_and_are_near_the_bound():
    rng = np.random.default_rng(5)
    for n in (1, 7, 300, 5000):
        hist = Counter(np.clip(rng.lognormal(5.5, 1, n).astype(int), 1, 1024).tolist())
        plan = packing.plan(hist, 1024)
        held = Counter()
        for config, copies in plan:
            assert copies > 0 and sum(k * c for k, c in config) <= 1024
            for k, c in config:
                held[k] += c * copies
        assert held == hist
        bound = -(-sum(k * c for k, c in hist.items()) // 1024)
        assert sum(c for _, c in plan) <= max(bound + 2, 1.02 * bound)
    assert packing.plan({}, 1024) == [] and sum(c for _, c in packing.plan({600: 10}, 1024)) == 10


def alone(hist, capacity):
    """Sequences of best-fit without the program."""
    left = {k: n for k, n in hist.items() if k < capacity}
    lengths = np.array(sorted(left), np.int64)
    return hist.get(capacity, 0) + sum(c for _, c in packing.best_fit(np.array([left[k] for k in sorted(left)], np.int64), lengths, capacity))


def fewest(pieces, capacity):
    """Sequences of an optimal packing, by search."""
    best = len(pieces)

    def place(k, room):
        nonlocal best
        if len(room) >= best:
            return
        if k == len(pieces):
            best = len(room)
            return
        for r in sorted({x for x in room if x >= pieces[k]}):
            room.remove(r)
            place(k + 1, [*room, r - pieces[k]])
            room.append(r)
        place(k + 1, [*room, capacity - pieces[k]])

    place(0, [])
    return best


def test_plans_of_few_pieces_against_a_search():
    rng = np.random.default_rng(11)
    ours = optimal = 0
    for _ in range(120):
        capacity = int(rng.integers(6, 40))
        pieces = sorted(rng.integers(1, capacity + 1, rng.integers(1, 10)).tolist(), reverse=True)
        hist = Counter(pieces)
        got, want = sum(c for _, c in packing.plan(hist, capacity)), fewest(pieces, capacity)
        assert want <= got <= min(want + 1, alone(hist, capacity))
        ours, optimal = ours + got, optimal + want
    assert ours <= 1.01 * optimal


@pytest.mark.parametrize("times", [1, 100])
def test_the_program_supplies_most_sequences(times):
    rng = np.random.default_rng(7)
    hist = Counter((rng.lognormal(6.3, 1.2, 8000).astype(int) % 1024 + 1).tolist())
    hist = {k: n * times for k, n in hist.items()}
    plan, supplied = packing.planned(hist, 1024)
    number = sum(c for _, c in plan)
    bound = -(-sum(k * c for k, c in hist.items()) // 1024)
    assert bound <= number <= min(1.0005 * bound + 1, alone(hist, 1024))
    assert supplied > 0.9 * (number - hist.get(1024, 0))


def test_the_bound_is_one_and_uses_cover():
    rng = np.random.default_rng(3)
    lengths = np.unique(rng.integers(40, 700, 300))
    counts = rng.integers(5, 60, len(lengths))
    configs, x, bound = packing.fractional(lengths, counts, 1024)
    assert bound >= (lengths * counts).sum() / 1024 - 1e-6 and (configs @ lengths <= 1024).all()
    assert np.abs(x @ configs / counts - 1)[configs.any(axis=0)].mean() < 0.02
    assert bound <= sum(c for _, c in packing.plan(dict(zip(lengths.tolist(), counts.tolist(), strict=True)), 1024))


def test_knapsack_equals_a_search():
    rng = np.random.default_rng(9)
    for _ in range(60):
        capacity = int(rng.integers(5, 25))
        lengths = np.unique(rng.integers(1, capacity + 1, 4))
        prices, most = rng.random(len(lengths)), rng.integers(1, 4, len(lengths))
        sack = packing.Knapsack(prices, lengths, most, capacity)
        every = np.array(np.meshgrid(*(np.arange(m + 1) for m in most))).reshape(len(most), -1).T
        for c in range(capacity + 1):
            fits = every[every @ lengths <= c]
            [best] = sack.best(np.array([c]))
            assert sack.value[c] == pytest.approx((fits @ prices).max()) == pytest.approx(best @ prices)
            assert best @ lengths <= c and (best <= most).all()


def test_packing_of_any_table(messy, clashing, empty):
    documents = [(r["doc_id"], r["text"]) for r in messy.collect()]
    for df in (messy, clashing):
        check_packing(packing.pack_documents(df, TOKENIZER).collect(), documents)
    check_packing(packing.pack_documents(messy, TOKENIZER, capacity=64).collect(), documents, 64)
    assert packing.pack_documents(empty, TOKENIZER).collect() == []


def test_sequences_hold_the_ids(messy):
    packed = packing.pack_documents(messy, TOKENIZER, keep_ids=True)
    whole = packing.sequences(packed).collect()
    of = packing.Ids(TOKENIZER).of
    assert sum(len(r["ids"]) for r in whole) == sum(len(x) + 1 for x in of([r["text"] or "" for r in messy.collect()]))
    assert all(len(r["ids"]) == r["length"] <= 1024 for r in whole)


def test_packing_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = QUERIES["op7_packing"](spark, sf).collect()
    assert check_packing(rows, docs) <= 1.05 * sum(r["length"] for r in rows) / 1024 + 1


# -- mixing


def test_budgets_go_to_siblings_first():
    capacity = {("a", "x"): 10.0, ("a", "y"): 100.0, ("b", "z"): 100.0}
    weight = {("a",): 0.5, ("b",): 0.5}
    assert mixing.split_budget(100, capacity, weight) == pytest.approx({("a", "x"): 10, ("a", "y"): 40, ("b", "z"): 50})
    assert mixing.split_budget(300, capacity, weight) == pytest.approx(capacity)
    assert mixing.split_budget(100, capacity, {("a",): 1.0, ("b",): 0.0}) == pytest.approx({("a", "x"): 10, ("a", "y"): 90, ("b", "z"): 0})
    small = {("a", "x"): 10.0, ("a", "y"): 15.0, ("b", "z"): 100.0}
    assert mixing.split_budget(100, small, weight) == pytest.approx({("a", "x"): 10, ("a", "y"): 15, ("b", "z"): 75})
    assert mixing.split_budget(5, {}, {}) == {}


def test_closed_leaves_are_no_room():
    capacity = {("a", "x"): 10.0, ("a", "y"): 100.0, ("b", "z"): 100.0}
    assert mixing.split_budget(100, capacity, {("a", "y"): 0.0}) == pytest.approx({("a", "x"): 10, ("a", "y"): 0, ("b", "z"): 90})
    open_ = {("a",): 1.0, ("b",): 1.0, ("a", "x"): 1.0, ("b", "z"): 1.0}
    assert mixing.split_budget(100, capacity, open_, default=0.0) == pytest.approx({("a", "x"): 10, ("a", "y"): 0, ("b", "z"): 90})


def test_what_prefixes_leave_goes_to_siblings_first():
    given = {("a", "x"): 10.0, ("a", "y"): 10.0, ("b", "z"): 10.0, ("b", "w"): 0.0}
    taken = {("a", "x"): 7, ("a", "y"): 6, ("b", "z"): 5, ("b", "w"): 0}
    following = {("a", "x"): [8, 1], ("a", "y"): [5, 1, 1], ("b", "z"): [6, 1], ("b", "w"): [1]}
    assert mixing.extended(given, taken, following) == {("a", "x"): 0, ("a", "y"): 3, ("b", "z"): 0, ("b", "w"): 0}
    assert mixing.extended(given, taken, following | {("a", "y"): [9]}) == {("a", "x"): 0, ("a", "y"): 0, ("b", "z"): 2, ("b", "w"): 0}
    assert mixing.extended({}, {}, {}) == {}


def brute_mix(rows, weight, budget, epochs, seed, per_range):
    from hashlib import md5

    leaves = defaultdict(list)
    for i, t, keys in rows:
        h = xxhash.xxh64_intdigest(t.encode(), 42) if t is not None else 42 and None
        h = 0 if t is None else h - (1 << 64) if h >> 63 else h
        leaves[tuple(None if k is None else str(k) for k in keys)].append((i, h, len((t or "").replace("\n", " ").replace("\t", " ").split(" ")) - (t or "").replace("\n", " ").replace("\t", " ").split(" ").count("")))
    given = mixing.split_budget(budget, {k: epochs * sum(n for *_, n in v) for k, v in leaves.items()}, weight)
    out, taken, following, after = Counter(), {}, {}, {}
    name = lambda leaf: "/".join("null" if k is None else k for k in leaf)
    for leaf, docs in leaves.items():
        total = sum(n for *_, n in docs)
        full, rest = divmod(int(given[leaf] + 1e-6), total) if total else (0, 0)
        for e in range(full):
            out.update((i, name(leaf), e, n) for i, _, n in docs)
        number = lambda d: int(md5(f"{seed}:{full}:{'null' if d[0] is None else d[0]}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
        groups = defaultdict(list)
        for d in docs:
            groups[number(d), d[0] is not None, d[0] or 0, d[1]].append(d)
        ranges = max(1, -(-len(docs) // per_range))
        of = lambda key: int(key[0] / (2.0**60 / ranges))  # noqa: B023, E731
        at, later = 0, []
        for key, same in sorted(groups.items()):
            n = sum(n for *_, n in same)
            if n and not later and at + n <= rest:
                at += n
                out.update((i, name(leaf), full, n) for i, _, n in same)
            elif n:
                later.append((key, n, [(i, name(leaf), full, n) for i, _, n in same]))
        taken[leaf] = full * total + at
        if later:
            edge = of(later[0][0])
            start = sum(n for key, same in groups.items() if of(key) < edge for *_, n in same)
            if start < rest:
                following[leaf] = [n for key, n, _ in later if of(key) == edge][:64]
                after[leaf] = [x for _, _, x in later]
    for leaf, more in mixing.extended(given, taken, following).items():
        for x in after.get(leaf, [])[:more]:
            out.update(x)
    return out


@pytest.mark.parametrize("per_range", [20_000, 3])
@pytest.mark.parametrize("share", [0.0, 0.4, 1.0, 2.5])
def test_mix_equals_brute_force(messy, clashing, per_range, share):
    rows = [(r["doc_id"], r["text"], (r["lang"], r["source"])) for r in messy.collect()]
    total = sum(len((t or "").split()) for _, t, _ in rows)
    weight = {("en",): 2.0, ("es",): 0.3, ("en", "src0"): 1.0}
    want = brute_mix(rows, weight, total * share, 3, 5, per_range)
    for df in (messy, clashing):
        got = mixing.mixed(df, [F.col("lang"), F.col("source")], weight, share=share, epochs=3, seed=5, per_range=per_range)
        assert Counter((r["id"], r["leaf"], r["epoch"], r["n_tokens"]) for r in got.collect()) == want


def test_mix_selects_rows(clashing, messy, empty):
    levels = [F.col("lang"), F.col("source")]
    some = [(r["doc_id"], r["text"]) for r in messy.collect() if (r["lang"], r["source"]) not in ((None, None), ("fr", None))]  # leaves of tokens
    out = mixing.select_mixed(clashing, levels, {}, share=1.0, epochs=1)
    assert out.columns == clashing.columns
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter(some)
    twice = mixing.select_mixed(messy, levels, {}, share=2.0, epochs=2)
    assert Counter((r["doc_id"], r["text"]) for r in twice.collect()) == Counter(some + some)
    assert mixing.select_mixed(empty, levels[:1], {}).collect() == []


def test_mixing_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op9_mixing"](spark, sf).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    per = Counter((r["doc_id"], r["epoch"]) for r in rows)
    assert max(per.values()) == 1 and all(r["n_tokens"] == len(docs[r["doc_id"]]["text"].split()) for r in rows)
    total = sum(len(d["text"].split()) for d in docs.values())
    web = sum(r["n_tokens"] for r in rows if r["leaf"].startswith("web/"))
    assert 0.999 * 0.8 * total < sum(r["n_tokens"] for r in rows) <= 0.8 * total and abs(web / (0.8 * total) - 0.5) < 0.05


@pytest.mark.parametrize("per_range", [20_000, 40, 7])
def test_mix_of_many_leaves_equals_brute_force(spark, per_range):
    rng = random.Random(21)
    rows = [(k, " ".join("w" * (1 + k % 3) for _ in range(rng.choice((1, 3, 20, 200)))), rng.choice("ab"), rng.choice("xyz")) for k in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    total = sum(len(t.split()) for _, t, *_ in rows)
    weight = {("a",): 0.7, ("b",): 0.3, ("a", "x"): 0.5}
    got = mixing.mixed(df, [F.col("lang"), F.col("source")], weight, share=0.55, epochs=2, seed=3, per_range=per_range).collect()
    assert Counter((r["id"], r["leaf"], r["epoch"], r["n_tokens"]) for r in got) == brute_mix([(i, t, (a, b)) for i, t, a, b in rows], weight, total * 0.55, 2, 3, per_range)
    if per_range == 20_000:
        assert 0.99 * 0.55 * total < sum(r["n_tokens"] for r in got) <= 0.55 * total
