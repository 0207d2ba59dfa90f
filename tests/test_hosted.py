"""Hosted stores, against one that lives in a file."""

import json
import os

import pytest

from millrace.operators.embed import hashing
from millrace.sources.hosted import PAGE, HostedStore, upstash, vectorize


def service(path):
    """A transport to a store that is a log of upserts; matches come in order of id, with rising scores."""

    def make():
        def call(action, body):
            with open(path, "a") as f:
                f.write(json.dumps([action, body]) + "\n")
            with open(path) as f:
                log = [json.loads(x) for x in f]
            items = {}
            for a, b in log:
                if a == "upsert":
                    items |= {i["id"]: i for i in b["items"]}
                elif a == "delete":
                    items = {k: v for k, v in items.items() if k not in b["ids"]}
                elif a == "reset":
                    items = {}
            keys = sorted(items)
            if action == "query":
                return {"matches": [{"id": k, "score": n * 0.7 - 0.2, "metadata": items[k]["metadata"]} for n, k in enumerate(keys)][: body["top_k"]]}
            if action == "range":
                at = int(body["cursor"])
                return {"ids": keys[at : at + body["limit"]], "next": str(at + body["limit"]) if at + body["limit"] < len(keys) else "0"}
            return {}

        return call

    return make


@pytest.mark.parametrize("embeddings", [None, hashing(4)], ids=["texts", "vectors"])
def test_round_trip(spark, tmp_path, embeddings):
    path = str(tmp_path / "log")
    store = HostedStore(service(path), embeddings, batch=2)
    docs = spark.createDataFrame([(f"d{k}", f"text {k}", json.dumps({"n": k}) if k else None) for k in range(5)], "id string, content string, metadata string").coalesce(1)
    assert store.index(docs) == 5
    sent = [json.loads(x)[1]["items"] for x in open(path)]
    assert [len(s) for s in sent] == [2, 2, 1] and all(("vector" in i) == (embeddings is not None) for s in sent for i in s)
    rows = store.search(spark, "text", limit=3, return_content=True).collect()
    assert [(r["rank"], r["id"], r["score"], r["content"]) for r in rows] == [(1, "d0", 0.0, "text 0"), (2, "d1", pytest.approx(0.5), "text 1"), (3, "d2", 1.0, "text 2")]
    assert rows[0]["metadata"] is None and json.loads(rows[1]["metadata"]) == {"n": 1}
    some = store.search(spark, "text", limit=1, where={"n": {"$gte": 2}}).collect()
    assert [r["id"] for r in some] == ["d2"] and some[0]["content"] is None
    assert store.search(spark, "text", limit=1, where={"n": 4}).collect() == []  # beyond four times the limit
    assert store.remove(["d1", "x"]) == 2 and list(store.list_ids()) == ["d0", "d2", "d3", "d4"]
    store.clear()
    assert list(store.list_ids()) == []


def test_ids_come_in_pages(tmp_path):
    path = str(tmp_path / "log")
    with open(path, "w") as f:
        f.write(json.dumps(["upsert", {"items": [{"id": f"{k:05}", "metadata": {}} for k in range(2 * PAGE + 1)]}]) + "\n")
    assert len(list(HostedStore(service(path)).list_ids())) == 2 * PAGE + 1


def test_stores_that_cannot_list(tmp_path):
    store = HostedStore(service(str(tmp_path / "log")), listable=False)
    for act in (store.clear, lambda: list(store.list_ids())):
        with pytest.raises(NotImplementedError):
            act()
    assert not os.path.exists(tmp_path / "log")


def test_requests_to_services():
    log = []

    def send(method, url, headers, body):
        log.append((method, url.split("example", 1)[-1].split("v4", 1)[-1], body))
        assert headers == {"Authorization": "Bearer key"}
        if "range" in url:
            return {"result": {"nextCursor": "7", "vectors": [{"id": "a"}]}}
        if "vectorize" in url:
            return {"result": {"matches": [{"id": "a", "score": 0.5, "metadata": {"x": 1}}]}}
        return {"result": [{"id": "a", "score": 0.5, "metadata": {"x": 1}}]}

    up, cf = upstash("https://example", "key", send)(), vectorize("acc", "ix", "key", send)()
    ask = {"namespace": "ns", "top_k": 3, "include_metadata": True}
    match = {"matches": [{"id": "a", "score": 0.5, "metadata": {"x": 1}}]}
    up("upsert", {"namespace": "ns", "items": [{"id": "a", "data": "t", "metadata": {}}]})
    up("upsert", {"namespace": "ns", "items": [{"id": "a", "vector": [1.0], "metadata": {}}]})
    assert up("query", {**ask, "data": "q"}) == match == up("query", {**ask, "vector": [1.0]}) == cf("query", {**ask, "vector": [1.0]})
    assert up("range", {"namespace": "ns", "cursor": "0", "limit": 5}) == {"ids": ["a"], "next": "7"}
    up("delete", {"namespace": "ns", "ids": ["a"]})
    up("reset", {"namespace": "ns"})
    cf("upsert", {"namespace": "ns", "items": [{"id": "a", "vector": [1.0], "metadata": {"k": 2}}, {"id": "b", "vector": [2.0], "metadata": {}}]})
    cf("delete", {"namespace": "ns", "ids": ["a"]})
    assert [u for _, u, _ in log] == ["/upsert-data/ns", "/upsert/ns", "/query-data/ns", "/query/ns", *["/accounts/acc/vectorize/v2/indexes/ix/query"], "/range/ns", "/delete/ns", "/reset/ns", "/accounts/acc/vectorize/v2/indexes/ix/upsert", "/accounts/acc/vectorize/v2/indexes/ix/delete_by_ids"]
    assert [json.loads(x)["id"] for x in log[-2][2].split("\n")] == ["a", "b"] and log[2][2] == {"data": "q", "topK": 3, "includeMetadata": True}
    with pytest.raises(NotImplementedError):
        cf("range", {"namespace": "ns"})
