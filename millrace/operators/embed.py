"""Embedding of texts: providers, batches of like cost, and a cache by content."""

from __future__ import annotations

import hashlib
import json
import re
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import content_hash

MOST_ITEMS = 64
BATCH_TOKENS = MOST_ITEMS * 128
CHARS_A_TOKEN = 4

Embedder = Callable[[Sequence[str]], list[list[float]]]
Transport = Callable[[str, dict, dict], dict]  # url, headers, body -> response


def estimated_tokens(chars: int) -> int:
    return max(1, -(-chars // CHARS_A_TOKEN))


def batch_sizes(lengths: Sequence[int]) -> list[int]:
    """Sizes of the batches for texts in order of length: as many as fit the token target, by the longest of the next 64."""
    out, at, n = [], 0, len(lengths)
    while at < n:
        longest = lengths[min(at + MOST_ITEMS, n) - 1]
        out.append(min(MOST_ITEMS, n - at, max(1, BATCH_TOKENS // estimated_tokens(longest))))
        at += out[-1]
    return out


def batch_runs(lengths: Sequence[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(number of batches, texts of each, longest text) of batch_sizes() in order, for (length, number of texts) by rising length; as many as there are lengths, not texts."""
    out: list[tuple[int, int, int]] = []
    k, left, rest = 0, lengths[0][1] if lengths else 0, sum(n for _, n in lengths)

    def ahead(n: int) -> int:
        """Length of the n-th text from here."""
        j, seen = k, left
        while seen < n:
            j += 1
            seen += lengths[j][1]
        return lengths[j][0]

    while rest:
        size = min(MOST_ITEMS, rest, max(1, BATCH_TOKENS // estimated_tokens(ahead(min(MOST_ITEMS, rest)))))
        times = (left - MOST_ITEMS) // size + 1 if left >= MOST_ITEMS else 1  # alike as long as the next texts are of one length
        out.append((times, size, ahead(size)))
        gone = times * size
        rest -= gone
        while gone and gone >= left:
            gone -= left
            k += 1
            left = lengths[k][1] if k < len(lengths) else 0
        left -= gone
    return out


def embed_all(embedder: Embedder, texts: Sequence[str], progress: Callable[[int, int], None] | None = None) -> list[list[float]]:
    """Embeddings in the order of the texts, made in batches in order of length."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    out: list[list[float] | None] = [None] * len(texts)
    if progress:
        progress(0, len(texts))
    at = 0
    for size in batch_sizes([len(texts[i]) for i in order]):
        mine = order[at : at + size]
        vectors = embedder([texts[i] for i in mine])
        if len(vectors) != len(mine):
            raise ValueError(f"{len(mine)} texts gave {len(vectors)} embeddings")
        for i, v in zip(mine, vectors, strict=True):
            out[i] = v
        at += size
        if progress:
            progress(at, len(texts))
    return out  # type: ignore[return-value]


@dataclass(frozen=True)
class Provider:
    """A model: `make()` runs once in each task and gives the embedder. dimensions None: asked by embedding one text."""

    make: Callable[[], Embedder]
    dimensions: int | None = None
    max_tokens: int | None = None

    def width(self) -> int:
        return self.dimensions or len(self.make()(["test"])[0])


def hashing(dimensions: int = 64) -> Provider:
    """A deterministic embedder without a model: signed hashed words, of norm 1."""

    def make() -> Embedder:
        def run(texts: Sequence[str]) -> list[list[float]]:
            out = []
            for t in texts:
                v = np.zeros(dimensions)
                for w in re.findall(r"\w+", t.lower()):
                    h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                    v[h % dimensions] += 1 if h >> 63 else -1
                n = np.linalg.norm(v)
                out.append((v / n if n else v).astype(np.float32).tolist())
            return out

        return run

    return Provider(make, dimensions)


def pooled(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean over the unmasked tokens of (text, token, dimension) states, then norm 1."""
    m = mask[..., None].astype(np.float64)
    v = (states * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1e-9)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n > 0, n, 1)


def post(url: str, headers: dict, body: dict) -> dict:
    """JSON by POST; an error status raises."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=60) as r:  # noqa: S310
        return json.load(r)


#: Widths of known models.
WIDTHS = {
    **dict.fromkeys("all-MiniLM-L6-v2 all-minilm bge-small-en-v1.5 embed-english-light-v3.0 embed-multilingual-light-v3.0".split(), 384),
    **dict.fromkeys("bge-base-en-v1.5 embedding-001 nomic-embed-text text-embedding-004".split(), 768),
    **dict.fromkeys("bge-large-en-v1.5 bge-m3 embed-english-v3.0 embed-multilingual-v3.0 mistral-embed mxbai-embed-large plamo-embedding-1b snowflake-arctic-embed".split(), 1024),
    **dict.fromkeys("text-embedding-3-small text-embedding-ada-002".split(), 1536),
    "embeddinggemma-300m": 256, "text-embedding-3-large": 3072,
}
#: Token windows of known models.
WINDOWS = {
    **dict.fromkeys("bge-base-en-v1.5 bge-large-en-v1.5 bge-small-en-v1.5 embed-english-v3.0 embeddinggemma-300m".split(), 512),
    **dict.fromkeys("text-embedding-3-large text-embedding-3-small text-embedding-ada-002".split(), 8191),
    **dict.fromkeys("bge-m3 nomic-embed-text".split(), 8192),
    "all-MiniLM-L6-v2": 256, "mistral-embed": 16384, "text-embedding-004": 2048,
}
#: Repositories of local models by short name.
LOCAL = {
    **{m: f"Xenova/{m}" for m in ("all-MiniLM-L6-v2", "bge-base-en-v1.5", "bge-m3", "bge-small-en-v1.5")},
    "bge-large-en-v1.5": "onnx-community/bge-large-en-v1.5", "embeddinggemma-300m": "onnx-community/embeddinggemma-300m-ONNX",
}


def short_name(model: str) -> str:
    return re.sub(r"^(?:Xenova|onnx-community)/", "", model)


def width_of(model: str) -> int | None:
    return WIDTHS.get(model) or WIDTHS.get(short_name(model))


def window_of(model: str) -> int | None:
    return WINDOWS.get(model) or WINDOWS.get(short_name(model))


@dataclass(frozen=True)
class _Service:
    model: str
    url: str
    body: Callable[[str, Sequence[str]], dict]
    vectors: Callable[[dict], list[list[float]]]
    key: Callable[[str], dict]


_BEARER = lambda k: {"Authorization": f"Bearer {k}"}
_OF_DATA = lambda r: [d["embedding"] for d in r["data"]]
SERVICES = {
    "openai": _Service("text-embedding-3-small", "https://api.openai.com/v1/embeddings", lambda m, t: {"model": m, "input": list(t)}, _OF_DATA, _BEARER),
    "mistral": _Service("mistral-embed", "https://api.mistral.ai/v1/embeddings", lambda m, t: {"model": m, "input": list(t)}, _OF_DATA, _BEARER),
    "cohere": _Service("embed-english-v3.0", "https://api.cohere.com/v2/embed", lambda m, t: {"model": m, "texts": list(t), "input_type": "search_document", "embedding_types": ["float"]}, lambda r: r["embeddings"]["float"], _BEARER),
    "google": _Service("text-embedding-004", "https://generativelanguage.googleapis.com/v1beta/models/{model}:batchEmbedContents", lambda m, t: {"requests": [{"model": f"models/{m}", "content": {"parts": [{"text": x}]}} for x in t]}, lambda r: [e["values"] for e in r["embeddings"]], lambda k: {"x-goog-api-key": k}),
    "ollama": _Service("nomic-embed-text", "http://localhost:11434/api/embed", lambda m, t: {"model": m, "input": list(t)}, lambda r: r["embeddings"], lambda k: {}),
}


def hosted(service: str, model: str | None = None, api_key: str = "", url: str | None = None, transport: Transport = post) -> Provider:
    """A hosted model; the transport can be replaced in tests. Known widths are not asked for."""
    s = SERVICES[service]
    name = model or s.model

    def make() -> Embedder:
        def run(texts: Sequence[str]) -> list[list[float]]:
            return s.vectors(transport((url or s.url).replace("{model}", name), s.key(api_key), s.body(name, texts))) if texts else []

        return run

    return Provider(make, width_of(name), window_of(name))


def local(load: Callable[[str], Embedder], model: str = "bge-small-en-v1.5", clear: Callable[[str], None] | None = None) -> Provider:
    """A model loaded in each task by `load(repository)`; after a failure its cache is cleared and it is tried once more."""
    if width_of(model) is None:
        raise ValueError(f"unknown dimensions of {model}")

    def make() -> Embedder:
        name = LOCAL.get(model, model)
        try:
            return load(name)
        except Exception:
            if clear is None:
                raise
            clear(name)
            return load(name)

    return Provider(make, width_of(model), window_of(model))


def embedded(df: DataFrame, text: str, provider: Provider, into: str = "embedding", done: Accumulator | None = None) -> DataFrame:
    """df with embeddings of a text column, as float arrays. Each task makes the embedder once; a null text counts as empty. `done` counts texts, batch by batch."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = provider.make()
        for texts in batches:
            before = [0]

            def tell(now: int, _: int) -> None:
                done.add(now - before[0])
                before[0] = now

            yield pd.Series(embed_all(embedder, [t or "" for t in texts], tell if done is not None else None), dtype=object)

    return df.withColumn(into, run(F.col(text)))


def cache_misses(df: DataFrame, cache: DataFrame, text: str) -> DataFrame:
    """(hash, text): the distinct texts of df that the cache (hash, embedding) does not have."""
    asked = df.select(content_hash(F.coalesce(F.col(text), F.lit(""))).alias("hash"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return asked.join(cache.select("hash"), "hash", "left_anti").dropDuplicates(["hash"])


def embedded_cached(df: DataFrame, text: str, provider: Provider, cache_path: str, into: str = "embedding") -> DataFrame:
    """embedded() through a cache table at cache_path: texts that it lacks are embedded once, whatever their number of rows, and appended."""
    spark = df.sparkSession
    schema = "hash string, embedding array<float>"
    spark.createDataFrame([], schema).write.mode("append").parquet(cache_path)
    cache = spark.read.schema(schema).parquet(cache_path)
    embedded(cache_misses(df, cache, text), "text", provider, "embedding").select("hash", "embedding").write.mode("append").parquet(cache_path)
    cache = spark.read.schema(schema).parquet(cache_path).dropDuplicates(["hash"]).select(F.col("hash").alias("__hash"), F.col("embedding").alias("__embedding"))
    keyed = df.withColumn("__hash", content_hash(F.coalesce(F.col(text), F.lit(""))))
    return keyed.join(cache, "__hash", "left").select(*(c for c in df.columns if c != into), F.col("__embedding").alias(into))
