"""Documents that arrive as a stream, kept in a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidewater.operators.embeddings import EmbeddingProvider
from tidewater.plans.ingest import ingest
from tidewater.sources.store import Store


def follow(arriving: DataFrame, store: Store, source_id: str, *, checkpoint: str, max_chunk_chars: int = 1000, provider: EmbeddingProvider | None = None, available_now: bool = False) -> StreamingQuery:
    """Upserts each batch of arriving (source_id, relative_path, content), with vectors by `provider` where an index is active. A batch is a delta
    of the store. A stream can't say what is missing, so nothing is deleted; a batch that runs again changes nothing. A batch with rows of
    another source, or with two contents for one path, is refused whole.
    """

    def upsert(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            ingest(store, source_id, batch, max_chunk_chars=max_chunk_chars, provider=provider, keep_missing=True)

    out = arriving.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()
