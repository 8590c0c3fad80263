"""Mentions in documents that arrive as a stream. Extraction has no state, so each micro-batch is a batch of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.extract import extract


def extract_stream(docs: DataFrame, patterns: DataFrame, to: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Writes the mentions of a stream doc_id, text to Parquet, a folder a batch: one that is run again replaces its own."""

    def batch(rows: DataFrame, number: int) -> None:
        extract(rows, patterns).write.mode("overwrite").parquet(f"{to}/batch={number}")

    writer = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
