"""The pipeline's stages, each on its own input, and together."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import secret_scan
from millrace.llm.mixing import PER_RANGE
from millrace.llm.queries import MIX
from test_tables import alone, brute_mix, check_packing

STAGES = dict(corpus_pipeline.STAGES)
SF = "/root/testdata/sf0.01"


def test_stages_and_oracle():
    assert list(STAGES) == ["quality_classifier", "simhash_near_dedup", "secret_scan", "source_mixing", "best_fit_packing"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", list(STAGES))
def test_any_table_goes_through_every_stage(spark, name, messy, clashing, empty):
    last = name == "best_fit_packing"
    for df in (messy, clashing, empty):
        out = STAGES[name](spark, df, SF)
        assert last or out.columns == df.columns
        rows = out.collect()
        assert len(rows) == 0 if df is empty else len(rows) > 0


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_classifier_drops_junk_and_keeps_clean_documents(spark, documents):
    kept = {r["doc_id"] for r in STAGES["quality_classifier"](spark, documents, SF).collect()}
    junk = re.compile(r"!!(?: |\n|$)|\*\*\*|%%%|\$\$\$|###| \| |(?<!\S)(\S+)(?: \1){4,}")
    rows = documents.collect()
    clean = [r["doc_id"] for r in rows if not junk.search(r["text"])]
    spoilt = [r["doc_id"] for r in rows if len(junk.findall(r["text"])) > 8]
    assert len(clean) > 700 and sum(i in kept for i in clean) >= 0.995 * len(clean)
    assert len(spoilt) > 50 and sum(i in kept for i in spoilt) <= 0.1 * len(spoilt)


def test_classifier_equals_scores_by_hand(spark, documents):
    from millrace.llm import quality
    from millrace.llm.queries import THRESHOLD

    model = quality.fit(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = quality.with_statistics(documents, "text").select("doc_id", *("s_" + s for s in quality.STATS)).toPandas()
    scores = model.scores(rows[["s_" + s for s in quality.STATS]].to_numpy(float))
    kept = {r["doc_id"] for r in STAGES["quality_classifier"](spark, documents, SF).collect()}
    assert kept == set(rows["doc_id"][scores >= THRESHOLD].tolist()) and 0 < len(model.rules) < 120


@pytest.mark.parametrize("names", [("log_words", "symbols", "upper", "distinct", "same_lines"), ("symbols",), ("symbols", "repeats")])
def test_classifier_computes_statistics_once_for_any_rules(spark, documents, monkeypatch, names):
    from millrace.llm import quality
    from millrace.llm.queries import THRESHOLD

    rows = quality.with_statistics(documents, "text").select("doc_id", *("s_" + s for s in quality.STATS)).toPandas()
    x = rows[["s_" + s for s in quality.STATS]].to_numpy(float)
    rules = [(((k, above, float(np.quantile(x[:, k], q))),), w if above else -w) for k in map(quality.STATS.index, names) for above in (False, True) for q, w in ((0.2, 0.7), (0.5, -0.4), (0.9, -0.9))]
    margin = sum(w * quality.holds(r, x) for r, w in rules)
    model = quality.RuleEnsemble(tuple(rules), float(np.log(THRESHOLD / (1 - THRESHOLD)) - margin.mean()))
    monkeypatch.setattr(quality, "fit", lambda *_: model)
    out = STAGES["quality_classifier"](spark, documents, SF)
    assert out._jdf.queryExecution().executedPlan().toString().count("regexp_replace(") <= 4
    want = set(rows["doc_id"][model.scores(x) >= THRESHOLD].tolist())
    assert {r["doc_id"] for r in out.collect()} == want and 0 < len(want) < len(rows)


def test_dedup_keeps_one_of_each_group(spark, documents):
    from millrace.llm.simhash import near_duplicates

    want = {r["component_id"] for r in near_duplicates(documents).collect()}
    got = [r["doc_id"] for r in STAGES["simhash_near_dedup"](spark, documents, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_secrets_are_masked_and_nothing_else_changes(spark, documents):
    before = {r["doc_id"]: r for r in documents.collect()}
    after = {r["doc_id"]: r for r in STAGES["secret_scan"](spark, documents, SF).collect()}
    assert before.keys() == after.keys()
    changed = [i for i in before if before[i] != after[i]]
    assert changed == [i for i in before if secret_scan.scan_text(before[i]["text"])[1]] or set(changed) == {i for i in before if secret_scan.scan_text(before[i]["text"])[1]}
    assert all(after[i]["n_chars"] == len(after[i]["text"]) and not secret_scan.scan_text(after[i]["text"])[1] for i in changed)


def test_mix_has_the_weights(spark, documents):
    from millrace.llm.mixing import words
    from millrace.llm.queries import domain

    out = STAGES["source_mixing"](spark, documents, SF)
    total = documents.agg(F.sum(words("text"))).first()[0]
    share = {r["d"]: r["n"] / total for r in out.groupBy(domain().alias("d")).agg(F.sum(words("text")).alias("n")).collect()}
    assert share["web"] == pytest.approx(0.5, abs=0.03) and share["books"] == pytest.approx(0.3, abs=0.03)
    assert max(Counter(r["doc_id"] for r in out.collect()).values()) <= 4
    rows = [(r["doc_id"], r["text"], (r["d"], r["lang"], r["source"])) for r in documents.withColumn("d", domain()).collect()]
    want = brute_mix(rows, MIX, total, 4, 7, PER_RANGE)
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(i for (i, *_), n in want.items() for _ in range(n))


def test_packing_stage_holds_all_documents(spark, documents):
    rows = STAGES["best_fit_packing"](spark, documents, SF).collect()
    number = check_packing(rows, [(r["doc_id"], r["text"]) for r in documents.collect()])
    lengths = Counter(r["length"] for r in rows)
    assert -(-sum(k * n for k, n in lengths.items()) // 1024) <= number <= alone(lengths, 1024)


def test_run_packs_what_the_stages_keep(spark, tmp_path):
    rows = corpus_pipeline.run(spark, SF).collect()
    used = Counter()
    for r in rows:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 1024 and np.mean(list(used.values())) > 0.95 * 1024
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
    assert Counter(r["doc_id"] for r in docs.collect()) == Counter({i: sum(1 for r in rows if r["doc_id"] == i and r["piece"] == 0) for i in {r["doc_id"] for r in rows}})
