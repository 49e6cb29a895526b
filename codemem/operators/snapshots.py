"""Content-hash change detection between two scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def fingerprints(files: DataFrame, keys: Sequence[str] = ("repo", "path"), content: str = "content") -> DataFrame:
    return files.select(*keys, F.sha2(F.col(content), 256).alias("sha256"))


def snapshot_diff(
    old: DataFrame, new: DataFrame, keys: Sequence[str] = ("repo", "path"), content: str = "content"
) -> DataFrame:
    """Keys with ``added``, ``deleted``, ``modified`` or ``unchanged``.

    Contents are hashed where they are read, and one aggregation meets both scans:
    only keys and hashes are shuffled, and a key that is repeated many times is
    combined inside each task.
    """
    absent = F.lit(None).cast("string")
    before = fingerprints(old, keys, content).select(*keys, F.col("sha256").alias("old"), absent.alias("new"))
    after = fingerprints(new, keys, content).select(*keys, absent.alias("old"), F.col("sha256").alias("new"))
    both = before.unionByName(after).groupBy(*keys).agg(F.max("old").alias("old"), F.max("new").alias("new"))
    state = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "deleted")
        .when(F.col("old") == F.col("new"), "unchanged")
        .otherwise("modified")
    )
    return both.select(*keys, state.alias("change_type"))
