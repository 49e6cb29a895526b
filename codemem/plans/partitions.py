"""Parquet tables in hash buckets, of which a change rewrites only those it touches.

A write replaces the partitions that occur in its rows (Spark's dynamic partition overwrite), so it can
be repeated and leaves the same table.  A partition that loses its last row gets a row without keys,
which readers leave out: an empty partition would otherwise not be replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from codemem.operators.joins import sized_join


def bucket(count: int, *keys: Column) -> Column:
    return F.format_string("%04d", F.pmod(F.xxhash64(*keys), F.lit(count)))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def clear(spark: SparkSession, path: str, schema: str, by: Sequence[str]) -> None:
    """Make the table an empty one."""
    writer = spark.createDataFrame([], schema).write.mode("overwrite").option("partitionOverwriteMode", "static")
    writer.partitionBy(*by).parquet(path)


def rows_of(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path).filter(F.col(key).isNotNull())


def names(touched: DataFrame, by: Sequence[str]) -> dict[str, list[str]]:
    """The names that occur in the touched partitions, level by level."""
    row = touched.agg(*[F.collect_set(name).alias(name) for name in by]).first()
    return {name: sorted(row[name]) for name in by}


def inside(rows: DataFrame, touched: DataFrame, known: dict[str, list[str]]) -> DataFrame:
    """Rows of the touched partitions; the scan lists no others with a name that does not occur."""
    for name, values in known.items():
        rows = rows.filter(F.col(name).isin(*values))
    return sized_join(rows, touched, list(known), "left_semi")


def dealt(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with their partition's others.

    Rebalancing cuts a partition that holds most rows into several files and merges the small ones.
    """
    return rows.hint("rebalance", *by)


def replace(
    rows: DataFrame, path: str, schema: str, touched: DataFrame, by: Sequence[str], order: Sequence[str], placed: DataFrame | None = None
) -> None:
    """The ``touched`` partitions, one row each, hold exactly ``rows`` from now on, and ``placed``.

    What is ``placed`` was made from rows that had been dealt, and does not move again; ``touched`` may leave
    out the partitions it has rows of.
    """
    fields = StructType.fromDDL(schema).fields
    none = [F.col(f.name) if f.name in by else F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
    columns = [f.name for f in fields]
    whole = dealt(rows.select(*columns).unionByName(touched.select(*none)), by)
    if placed is not None:
        whole = whole.unionByName(placed.select(*columns))
    # Sorted ids let a look-up of single rows skip most row groups.
    out = whole.sortWithinPartitions(*by, *order)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
