"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "codemem") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CODEMEM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder path under the shared folder the cluster names.

    Only a local session without that setting gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = os.path.join(tempfile.gettempdir(), "codemem-work")
    return f"{base.rstrip('/')}/codemem-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in a folder of its own: what follows starts there."""
    at = work_dir(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


class Scratch:
    """Written tables that are removed together once the work that reads them is done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.at, self.count = spark, work_dir(spark, "scratch"), 0

    def written(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.at}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *problem) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.at)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def mounted(path: str) -> str:
    """The plain form of a folder that Python code on the executors opens itself."""
    plain = path.removeprefix("file:")
    if "://" in plain.lstrip("/"):
        raise ValueError(f"{path} is not a mounted folder")
    return "/" + plain.lstrip("/") if path.startswith("file:") else plain
