"""Documents that arrive as a stream are indexed batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from millrace.plans.engine import SearchEngine


def ingest(documents: DataFrame, engine: SearchEngine, checkpoint: str, once: bool = False, compact_every: int = 50) -> StreamingQuery:
    """Start indexing a stream of (id, content, metadata). once: what is there now, then stop.

    Each micro-batch becomes a segment; a batch that is delivered again replaces its own documents, so results are as if it
    came once. Every `compact_every` batches segments are joined.
    """

    def take(batch: DataFrame, number: int) -> None:
        engine.index(batch)
        if number % compact_every == compact_every - 1:
            engine.compact()

    writer = documents.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
