"""The search engine: documents are chunked, indexed by words and by vectors, and found by both."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import identifiers as I
from millrace.functions import text as X
from millrace.functions import vectors as V
from millrace.operators import bm25, filters, fusion, knn
from millrace.operators.chunking import Chunk, chunked
from millrace.operators.embed import Provider, embedded, embedded_cached
from millrace.operators.rerank import Reranker
from millrace.session import shared_dir, written
from millrace.sources.store import REMOVED, Store

MODES = ("hybrid", "composed", "keyword", "vector")
#: Fields of the index and their weights. A hit of weight 0 matches and takes a rank but adds nothing.
WEIGHTS = {"hybrid": {"id": 0.0, "headers": 2.0, "content": 1.0, "metadata": 0.0}, "keyword": {"id": 1.0, "content": 1.0}}
SORT = {"postings": ("term", "id"), "chunks": ("id",), "vectors": ("cell", "id")}
CELLS = "CELLS"
TABLES = ("chunks", "postings", "lengths", "vectors")
SCORES = {"l2": V.l2_score, "cosine": V.cosine_score, "ip": V.ip_score}
KEYS = ("seg", "id")


class SearchEngine:
    """Documents (id, content, metadata as a JSON text) in; ranked results out.

    path: the index's folder; None: a new one in the shared folder, for as long as that lasts. mode: "hybrid" fuses the words' AND list (weight 1), OR list (0.5) and the vectors' list (1) in one step; "composed"
    fuses the vectors' list with the keyword list, itself fused of AND and OR; "keyword" and "vector" search one way.
    categorize: an expression for a document's category; with more than one category, each is searched for itself and
    the lists are interleaved. fields: metadata keys kept as typed columns {name: type}, on which filters reach the
    Parquet scan; all others are read from the JSON. Metadata that is no JSON object counts as none where a category is put in. cells: inverted cells of vectors, fitted on the first batch; searches without
    filter then read the cells nearest to the query, as many as found `recall` of the neighbours of that batch's sample. None: all vectors are compared.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, mode: str = "hybrid", embeddings: Provider | None = None, metric: str = "l2", chunker: Callable[[str, str], list[Chunk]] | None = None, categorize: Column | None = None, reranker: Reranker | None = None, fields: Mapping[str, str] | None = None, embedding_cache: str | None = None, progress: Callable[[str, int, int], None] | None = None, cells: int | None = None, recall: float = 0.95):
        if mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        if mode != "keyword" and embeddings is None:
            raise ValueError("embeddings are required unless the mode is keyword")
        self.spark, self.store, self.mode, self.metric = spark, Store(spark, path or f"{shared_dir(spark)}/engine-{uuid.uuid4().hex}"), mode, metric
        self.embeddings, self.chunker, self.categorize, self.reranker = embeddings, chunker, categorize, reranker
        self.fields, self.cache, self.progress = dict(fields or {}), embedding_cache, progress
        self.weights = WEIGHTS["hybrid" if mode == "hybrid" else "keyword"]
        self.cells, self.recall = cells, recall
        self._known: tuple[int, int, int] | None = None  # manifest, rows and terms

    # -- writing

    def _tell(self, phase: str, current: int, total: int) -> None:
        if self.progress:
            self.progress(phase, current, total)

    @contextmanager
    def _told(self, phase: str, total: int) -> Iterator[Accumulator | None]:
        """Tells a phase's start and end, and between them what tasks that end add to the accumulator it gives."""
        if not self.progress:
            yield None
            return
        done, over = self.spark.sparkContext.accumulator(0), threading.Event()

        def watch() -> None:
            last = 0
            while not over.wait(0.2):
                if last < (now := min(done.value, total - 1)):
                    last = now
                    self._tell(phase, now, total)

        self._tell(phase, 0, total)
        watcher = threading.Thread(target=watch, daemon=True)
        watcher.start()
        try:
            yield done
        finally:
            over.set()
            watcher.join()
        self._tell(phase, total, total)

    def _prepared(self, docs: DataFrame, done: Accumulator | None = None) -> DataFrame:
        rest = [c for c in ("metadata",) if c in docs.columns]
        df = docs.select(F.col("id").cast("string").alias("id"), F.coalesce(F.col("content"), F.lit("")).alias("content"), *(rest or [F.lit(None).cast("string").alias("metadata")]))
        if self.categorize is not None:
            df = df.withColumn("category", self.categorize.cast("string"))
            held = F.expr("try_variant_get(try_parse_json(metadata), '$', 'map<string,variant>')")
            value = F.expr("variant_get(parse_json(to_json(array(category))), '$[0]', 'variant')")
            none = F.expr("cast(map() as map<string,variant>)")
            rest_ = F.map_filter(F.coalesce(held, none), lambda k, _: k != "category")  # the category replaces a key of that name
            df = df.withColumn("metadata", F.to_json(F.map_concat(rest_, F.create_map(F.lit("category"), value))))
        else:
            df = df.withColumn("category", F.lit(None).cast("string"))
        for name, kind in self.fields.items():
            df = df.withColumn(f"m_{name}", F.try_variant_get(F.try_parse_json("metadata"), "$." + name, kind))
        if self.chunker is None:
            return df.withColumns({"parent_id": F.lit(None).cast("string"), "chunk_index": F.lit(None).cast("int")})
        return chunked(df, self.chunker, done=done)

    def index(self, docs: DataFrame) -> int:
        """Add documents or replace those of the same ids, with all their chunks. Returns the number of rows (chunks) written.

        Of several documents of one id in a batch one is kept. Work and writes follow the batch, not what is stored.
        """
        docs = docs.dropDuplicates(["id"])
        with self._told("chunking", docs.count() if self.progress else 0) as done:
            df = self._prepared(docs, done).withColumn("doc", F.coalesce("parent_id", "id"))
            rows = written(df, "prepared")  # chunks are cut once, and read by each index
        tables = {"chunks": rows}
        count = rows.count()
        if self.mode != "keyword":
            with self._told("embedding", count) as done:
                make = (lambda d: embedded_cached(d, "content", self.embeddings, self.cache)) if self.cache else (lambda d: embedded(d, "content", self.embeddings, done=done))
                vectors = make(rows.select("id", "doc", "content"))
                vectors = written(vectors.select("id", "doc", V.same_width(F.col("embedding"), self.embeddings.width()).alias("embedding")), "vectors")  # embedded once
            tables["vectors"] = self._in_cells(vectors)
        if self.mode != "vector":
            posts = written(bm25.postings(rows.withColumn("headers", X.headings(F.col("content"))), "id", list(self.weights), carry=["doc"]), "postings")
            tables["postings"] = posts
            tables["lengths"] = rows.select("id", "doc").join(bm25.lengths(posts), "id", "left").select("id", "doc", F.coalesce("dl", F.lit(0)).cast("long").alias("dl"))
        tables[REMOVED] = rows.select("doc").distinct()
        with self._told("storing", count):
            self.store.append(tables, SORT)
        return count

    def _in_cells(self, vectors: DataFrame) -> DataFrame:
        if self.cells is None:
            return vectors.withColumn("cell", F.lit(0))
        if (known := self.store.get(CELLS)) is None:
            known = knn.Cells.fit(vectors, "id", "embedding", self.cells, self.metric, self.recall).to_json()
            self.store.put(CELLS, known)
        return knn.Cells.from_json(known).assigned(vectors, "embedding")

    def remove(self, ids: Iterable[str] | DataFrame) -> int:
        """Remove documents by id (a list, or a table's column `id`), with all their chunks, or single chunks' documents by a chunk's id. Returns the number of ids given."""
        if isinstance(ids, DataFrame):
            given = written(ids.select(F.col("id").cast("string").alias("id")), "ids")
            number = given.count()
        else:
            listed = [(i,) for i in ids]
            given, number = self.spark.createDataFrame(listed, "id string"), len(listed)
        chunks = self.store.read("chunks")
        if chunks is None:
            return number
        docs = given.select(F.col("id").alias("doc")).unionByName(chunks.join(given, "id", "left_semi").select("doc")).distinct()
        self.store.append({REMOVED: docs})
        return number

    def list_ids(self) -> DataFrame:
        """(id) of the documents, chunks under their document."""
        chunks = self.store.read("chunks")
        return self.spark.createDataFrame([], "id string") if chunks is None else chunks.select(F.col("doc").alias("id")).distinct()

    def compact(self) -> None:
        """Join all segments into one."""
        self.store.compact(TABLES, SORT)

    def clear(self) -> None:
        self.store.clear()
        self.store.delete(CELLS)

    def close(self) -> None:
        """Nothing is held between calls; there for symmetry."""

    # -- reading

    def _resolver(self, df: DataFrame) -> filters.Resolver:
        typed, rest = filters.columns(df), filters.json("metadata")

        def resolve(name: str) -> filters.Field:
            if name in self.fields:
                return typed(f"m_{name}")
            return typed("category") if name == "category" and self.categorize is not None else rest(name)

        return resolve

    def search(self, query: str, limit: int | None = 10, return_content: bool = False, return_metadata: bool = True, return_meta: bool = False, where: Mapping[str, object] | None = None) -> DataFrame:
        """(rank, id, score, content, metadata, chunk, meta) of the best rows, best first; limit None or 0: all that the lists of twice 10 hold.

        content is the snippet around the best line, and meta its highlights, if asked for by return_content. return_meta
        is accepted and changes nothing.
        """
        expanded = I.expand(query)
        wanted = limit or 10
        fetch = wanted * 3 if self.reranker and limit else wanted
        chunks = self.store.read("chunks")
        if chunks is None:
            return self.spark.createDataFrame([], "rank int, id string, score double")
        test = filters.compiled(where, self._resolver(chunks))
        allowed = chunks if test is None else chunks.where(test)
        categories = self.categorize is not None and chunks.select("category").distinct().limit(2).count() > 1
        by = ["category"] if categories else []
        lists = self._lists(expanded, fetch, allowed.select(*KEYS, *by), test is not None or categories, by)
        if not lists:
            return self.spark.createDataFrame([], "rank int, id string, score double")
        if categories:
            merged = fusion.fanned_out(lists, "category", carry=["seg"])
        elif len(lists) == 1:
            merged = lists[0].select("id", "seg", F.col("own").alias("score"), F.lit(0).alias("first_list"), F.col("rank").alias("first_rank"))
        else:
            merged = fusion.fused(lists, carry=["seg"])
        order = fusion.order() if len(lists) > 1 or categories else [F.col("first_rank")]
        final = fetch if limit else 2 * fetch
        best = fusion.ranked(merged, order, 0, limit=final).select("rank", "seg", "id", "score")
        out = self._filled(best, chunks, expanded, return_content or self.reranker is not None, return_metadata)
        if self.reranker:
            out = self.reranker(query, out)
            if not return_content:
                out = out.withColumn("content", F.lit(None).cast("string"))
        if limit:
            out = out.where(F.col("rank") <= limit)
        return out.orderBy("rank")

    def _lists(self, query: str, fetch: int, allowed: DataFrame, restricted: bool, by: Sequence[str]) -> list[DataFrame]:
        """Ranked lists to be fused, in the order of ties; each with its own score as `own`."""
        words = self._word_lists(query, fetch, allowed, restricted, by) if self.mode != "vector" else []
        if self.mode == "keyword":
            return words
        near = self._vector_list(query, fetch * 2 if self.mode == "hybrid" else fetch, allowed, restricted, by)
        if self.mode == "vector":
            return [near]
        if self.mode == "hybrid":
            return [*words, near.withColumn("list", F.lit(2))]
        if not words:
            return [near]
        keyword = words[0]
        if len(words) > 1:
            keyword = fusion.ranked(fusion.fused(words, carry=["seg"], by=by), fusion.order(), 1, limit=fetch, by=by).withColumn("own", F.col("score"))
        return [near.withColumn("list", F.lit(0)), keyword.withColumn("list", F.lit(1)).withColumn("weight", F.lit(1.0)).where(F.col("rank") <= fetch)]

    def _counts(self) -> tuple[int, int]:
        """Live rows and their terms; counted once for each state of the store."""
        version = self.store.version()
        if self._known is None or self._known[0] != version:
            row = self.store.read("lengths").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
            self._known = (version, row[0], row[1])
        return self._known[1:]

    def _word_lists(self, query: str, fetch: int, allowed: DataFrame, restricted: bool, by: Sequence[str]) -> list[DataFrame]:
        match = I.match(query, "or")
        index = self.store.read("postings")
        if match is None or index is None:
            return []
        rows, tokens = self._counts()
        hits = bm25.find(index.drop("doc"), rows, tokens, match.phrases, list(self.weights.values()), keys=KEYS)
        if hits is None:
            return []
        out = []
        for number, (mode, weight) in enumerate((("and", 1.0), ("or", 0.5))[: 1 if len(match.phrases) == 1 else 2]):
            scored = hits.scored(KEYS, mode)
            if restricted:
                scored = scored.join(allowed, list(KEYS))
            order = [F.round("bm25", 9).desc(), F.col("id")]
            out.append(fusion.ranked(scored, order, number, weight, 2 * fetch, by).withColumn("own", V.keyword_score(F.col("bm25"))))
        return out

    def _vector_list(self, query: str, fetch: int, allowed: DataFrame, restricted: bool, by: Sequence[str]) -> DataFrame:
        asked = self.embeddings.make()([query])
        if not asked:
            raise ValueError("no embedding of the query")
        rows = self.store.read("vectors")
        if restricted:
            rows = rows.join(allowed, list(KEYS))
        elif self.cells is not None and (known := self.store.get(CELLS)) is not None:
            rows = knn.Cells.from_json(known).probed(rows, asked[0])
        away = knn.with_distance(rows, "embedding", asked[0], self.metric).select(*KEYS, *by, "distance")
        order = [F.round("distance", 9).asc_nulls_last(), F.col("id")]
        return fusion.ranked(away, order, 0, 1.0, fetch, by).withColumn("own", SCORES[self.metric](F.col("distance")))

    def _filled(self, best: DataFrame, chunks: DataFrame, query: str, content: bool, metadata: bool) -> DataFrame:
        """Payload for the few rows that are left."""
        out = F.broadcast(best).join(chunks, list(KEYS))  # at most three times the limit
        scores = X.term_scores(F.col("content"), query)
        columns = [F.col("rank"), F.col("id"), F.col("score")]
        columns.append((X.snippet(F.col("content"), scores, query) if content else F.lit(None).cast("string")).alias("content"))
        columns.append((F.col("metadata") if metadata else F.lit(None).cast("string")).alias("metadata"))
        part = F.struct("parent_id", F.col("chunk_index").alias("index"), *([F.col("chunk.start").alias("start"), F.col("chunk.end").alias("end"), "chunk.first_line", "chunk.last_line", "chunk.entities", "chunk.scope"] if "chunk" in chunks.columns else []))
        columns.append(F.when(F.col("parent_id").isNotNull(), part).alias("chunk"))
        found = X.highlights(scores)
        columns.append((F.when(F.size(found) > 0, F.struct(found.alias("highlights"))) if content else F.lit(None).cast("struct<highlights:array<string>>")).alias("meta"))
        return out.select(*columns)
