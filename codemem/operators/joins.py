"""Joins against tables whose size is not known in advance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def sized_join(large: DataFrame, other: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Join on narrow keys, without a hint.

    The adaptive planner measures ``other`` after its own shuffle, broadcasts it when
    it is below the session's threshold in bytes, and splits hot partitions of ``large``
    when it is not.
    """
    return large.join(other, list(on), how)
