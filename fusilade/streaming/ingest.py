"""Micro-batch ingestion: new documents are chunked and replace their document's chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import replace_chunks


def ingest(stream: DataFrame, to_chunks: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, by: str = "document_id") -> StreamingQuery:
    """Runs what is available, batch by batch; a batch that is run again writes the same partitions."""

    def batch(df: DataFrame, _: int) -> None:
        replace_chunks(df.sparkSession, to_chunks(df), path, by)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
