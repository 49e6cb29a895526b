"""Decision log as a stream: new rows enter the memory once each."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from codemem.operators.memory import decision_docs
from codemem.plans.store import MemoryStore


def stream_decisions(decisions: DataFrame, store: MemoryStore, checkpoint: str) -> None:
    """Remember a streaming ``decisions(id, ts, text)`` until it is drained.

    Which ids have been seen is the stream's own keyed state, without a time after which it forgets: a
    decision is never too late and a repeated one never enters twice.  A batch is stored as a part that
    bears its number.  It reads nothing of what is stored, and when it is run again after a
    failure it writes the same part again, documents and chunks.
    """
    name = f"stream-{zlib.crc32(checkpoint.encode()):08x}"

    def remember(batch: DataFrame, number: int) -> None:
        store.ingest(batch, label=f"{name}-{number:010d}")

    new = decision_docs(decisions).dropDuplicates(["doc_id"])
    query = new.writeStream.foreachBatch(remember).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_stream(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """Stream of the Parquet files in a folder whose names match ``glob``."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def decisions_from_events(events: DataFrame) -> DataFrame:
    """Events as decisions, with the types of a decision log."""
    blank = F.col("event_id") % 31 == 0
    text = F.concat(F.lit("Use "), "event_type", F.lit(" settings "), "props")
    return events.select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(blank, "").otherwise(text).alias("text"),
    )
