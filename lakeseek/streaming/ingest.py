"""An extension: a stream of documents, ingested batch by batch."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.service import Lakeseek


def ingest_stream(engine: Lakeseek, docs: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Writes a streaming DataFrame of documents into the engine; each micro-batch is one ingest.

    A batch that is replayed after a crash is the same ingest, known by the
    checkpoint's path and the batch's number, so no version is made twice.
    """
    name = hashlib.md5(checkpoint.encode()).hexdigest()

    def one(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            engine.ingest(batch, ingest_id=f"{name}-{number}")

    writer = docs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
