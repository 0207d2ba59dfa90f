"""Vector stores behind an HTTP service. The transport is given, so nothing here needs a network to be tested.

A service embeds texts itself (`embeddings` None) or takes vectors. Its filters are not used: four times the limit is
fetched, matched in memory and cut, so a search may return fewer rows than asked for.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession

from millrace.operators.embed import Provider, embed_all
from millrace.operators.filters import matches

CONTENT = "_content"
PAGE = 1000
Transport = Callable[[str, dict], dict]  # action ("upsert", "query", "range", "delete", "reset"), body -> response
RESULT = "rank int, id string, score double, content string, metadata string"


Send = Callable[[str, str, dict, object], dict]  # method, url, headers, body (lines of JSON if a list of texts) -> response


def send_json(method: str, url: str, headers: dict, body: object) -> dict:
    """One request; an error status raises."""
    lines = isinstance(body, str)
    data = body.encode() if lines else json.dumps(body).encode()
    request = urllib.request.Request(url, data, {"Content-Type": "application/x-ndjson" if lines else "application/json", **headers}, method=method)
    with urllib.request.urlopen(request, timeout=60) as r:  # noqa: S310
        return json.load(r)


def upstash(url: str, token: str, send: Send = send_json) -> Callable[[], Transport]:
    """A transport to Upstash Vector's REST interface; texts are embedded there unless vectors come with them."""
    head = {"Authorization": f"Bearer {token}"}

    def call(action: str, body: dict) -> dict:
        space = body["namespace"]
        if action == "upsert":
            kind = "upsert" if body["items"] and "vector" in body["items"][0] else "upsert-data"
            return send("POST", f"{url}/{kind}/{space}", head, body["items"])
        if action == "query":
            kind, key = ("query", "vector") if "vector" in body else ("query-data", "data")
            found = send("POST", f"{url}/{kind}/{space}", head, {key: body[key], "topK": body["top_k"], "includeMetadata": body["include_metadata"]})["result"]
            return {"matches": [{"id": m["id"], "score": m["score"], "metadata": m.get("metadata")} for m in found]}
        if action == "range":
            page = send("POST", f"{url}/range/{space}", head, {"cursor": body["cursor"], "limit": body["limit"]})["result"]
            return {"ids": [v["id"] for v in page["vectors"]], "next": page["nextCursor"]}
        if action == "delete":
            return send("DELETE", f"{url}/delete/{space}", head, {"ids": body["ids"]})
        return send("DELETE", f"{url}/reset/{space}", head, {})

    return lambda: call


def vectorize(account: str, index: str, token: str, send: Send = send_json) -> Callable[[], Transport]:
    """A transport to Cloudflare Vectorize's REST interface, which takes vectors and cannot list ids."""
    head, at = {"Authorization": f"Bearer {token}"}, f"https://api.cloudflare.com/client/v4/accounts/{account}/vectorize/v2/indexes/{index}"

    def call(action: str, body: dict) -> dict:
        if action == "upsert":
            lines = [json.dumps({"id": x["id"], "values": x["vector"], "metadata": x["metadata"], "namespace": body["namespace"]}) for x in body["items"]]
            return send("POST", f"{at}/upsert", head, "\n".join(lines))
        if action == "query":
            asked = {"vector": body["vector"], "topK": body["top_k"], "returnMetadata": "all" if body["include_metadata"] else "none", "namespace": body["namespace"]}
            return {"matches": send("POST", f"{at}/query", head, asked)["result"]["matches"]}
        if action == "delete":
            return send("POST", f"{at}/delete_by_ids", head, {"ids": body["ids"]})
        raise NotImplementedError(f"this store has no {action}")

    return lambda: call


@dataclass(frozen=True)
class HostedStore:
    """transport: makes, in each task, the function that sends; namespace: a part of the store; listable: whether it can page through ids and be cleared."""

    transport: Callable[[], Transport]
    embeddings: Provider | None = None
    namespace: str = "chunks"
    batch: int = 100
    listable: bool = True

    def index(self, docs: DataFrame) -> int:
        """Upsert (id, content, metadata) in batches from every task, whose repetition does no harm; returns the number of rows."""
        store = self
        docs = docs.select("id", "content", "metadata")
        sent = docs.sparkSession.sparkContext.accumulator(0)  # a task that is done again after a loss may count twice

        def send(rows: Iterator[Row]) -> None:
            call, held = store.transport(), []
            embedder = store.embeddings.make() if store.embeddings else None

            def flush() -> None:
                texts = [r["content"] or "" for r in held]
                vectors = embed_all(embedder, texts) if embedder else [None] * len(held)
                items = []
                for r, t, v in zip(held, texts, vectors, strict=True):
                    item = {"id": r["id"], "metadata": {**json.loads(r["metadata"] or "{}"), CONTENT: t}}
                    items.append(item | ({"vector": v} if embedder else {"data": t}))
                call("upsert", {"namespace": store.namespace, "items": items})
                sent.add(len(held))
                held.clear()

            for r in rows:
                held.append(r)
                if len(held) >= store.batch:
                    flush()
            if held:
                flush()

        docs.foreachPartition(send)
        return sent.value

    def search(self, spark: SparkSession, query: str, limit: int = 10, return_content: bool = False, return_metadata: bool = True, where: Mapping[str, object] | None = None) -> DataFrame:
        """(rank, id, score, content, metadata), the service's scores kept between 0 and 1."""
        body = {"namespace": self.namespace, "top_k": limit * 4 if where else limit, "include_metadata": True}
        body |= {"vector": self.embeddings.make()([query])[0]} if self.embeddings else {"data": query}
        rows = []
        for m in self.transport()("query", body)["matches"]:
            metadata = dict(m.get("metadata") or {})
            content = metadata.pop(CONTENT, None)
            if matches(where, metadata):
                rows.append((len(rows) + 1, str(m["id"]), min(1.0, max(0.0, float(m["score"]))), content if return_content else None, json.dumps(metadata) if return_metadata and metadata else None))
        return spark.createDataFrame(rows[:limit], RESULT)

    def remove(self, ids: list[str]) -> int:
        self.transport()("delete", {"namespace": self.namespace, "ids": ids})
        return len(ids)

    def list_ids(self) -> Iterator[str]:
        """All ids, a page at a time."""
        if not self.listable:
            raise NotImplementedError("this store cannot list its ids")
        call, cursor = self.transport(), "0"
        while True:
            page = call("range", {"namespace": self.namespace, "cursor": cursor, "limit": PAGE})
            yield from (str(i) for i in page["ids"])
            cursor = page["next"]
            if cursor in ("", "0"):
                return

    def clear(self) -> None:
        if not self.listable:
            raise NotImplementedError("this store cannot be cleared")
        self.transport()("reset", {"namespace": self.namespace})
