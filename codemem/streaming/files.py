"""Source trees as streams: what is added or changed enters the memory in the background."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codemem.plans import remember as rm
from codemem.plans.store import MemoryStore
from codemem.session import Scratch


def stream_files(files: DataFrame, store: MemoryStore, checkpoint: str, seconds: float | None = None) -> None:
    """Remember a streaming ``files(repo, path, content)``, their symbols and comments.

    Runs until the stream is drained, or every ``seconds`` until it is stopped.  A file's documents take the
    place of its earlier ones, so a batch that is run again after a failure changes nothing.
    """

    def remember(batch: DataFrame, _: int) -> None:
        with Scratch(store.spark) as scratch:
            store.ingest(rm.remember(batch.filter(F.col("content").isNotNull()), scratch=scratch), replace=True)

    writer = files.writeStream.foreachBatch(remember).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")
    writer.start().awaitTermination()
