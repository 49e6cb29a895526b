"""Helpers shared by the training-data operators: tables, shared storage, Arrow texts and components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

# The white space that separates words, as a character class and as bytes.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_BYTES = b" \t\n\x0b\x0c\r"

# Spark's setting by which shuffle files go when the rows they were made for are written, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Bytes of text that one round of array work takes; a longer text is one round of its own.
CHUNK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ensure_checkpoints(spark: SparkSession) -> None:
    """Sets a checkpoint folder where the session names none, which only a local session may lack."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
            base = os.path.join(tempfile.gettempdir(), "codemem-checkpoints")
        context.setCheckpointDir(base)


def stored(df: DataFrame, name: str, compression: str = "snappy", level: int = 3, clean: bool = False) -> DataFrame:
    """The rows written as Parquet below the shared checkpoint folder, and read again; ``level`` is that of zstd.

    ``clean``: what was shuffled for them is removed once they are written, for rows that nothing else is made from.
    """
    ensure_checkpoints(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    write = df.write.option("compression", compression).option("parquet.compression.codec.zstd.level", level)
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(CLEANUP, "false")
    try:
        if clean:
            conf.set(CLEANUP, "true")
        write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_of(df: DataFrame, most: int) -> list[DataFrame]:
    """A ``stored`` table in parts of about ``most`` rows, each of whole files: what one task wrote stays together."""
    files = sorted(unquote(f) for f in df.inputFiles())
    n = min(len(files), -(-df.count() // most))
    return [df.sparkSession.read.schema(df.schema).parquet(*files[i::n]) for i in range(n)] if n > 1 else [df]


def discard(*tables: DataFrame) -> None:
    """Removes ``stored`` tables that nothing is made from any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for folder in {unquote(f).rpartition("/")[0] for f in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The rows written once to the shared checkpoint folder, with the lineage cut there."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()


@lru_cache(maxsize=1)
def _space() -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(SPACE_BYTES)] = True
    return out


def ascii_lower() -> np.ndarray:
    """Byte table that lowers A-Z and leaves every other byte alone."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    kind, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def rounds(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with a bounded number of text bytes, their bytes and their offsets."""
    for batch in batches:
        data, offsets = raw(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last


_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNDO = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]))
        if size > 4 * CHUNK_BYTES:
            return have
        _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _byte_codes(lower: bool) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=np.uint64))
    return codes[ascii_lower()] if lower else codes


class Words:
    """The words of several texts: 64-bit hash, row, and byte range of each, in order.

    ``inner`` is a table of the bytes that words consist of; by default all but white space.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, inner: np.ndarray | None = None):
        word = ~_space()[data] if inner is None else inner[data]
        before = np.empty_like(word)
        before[:1] = False
        before[1:] = word[:-1]
        inner = offsets[1:-1]
        inner = inner[inner < len(data)]
        before[inner] = False
        self.start = np.flatnonzero(word & ~before)
        after = np.empty_like(word)
        after[-1:] = False
        after[:-1] = word[1:]
        after[inner[inner > 0] - 1] = False
        self.end = np.flatnonzero(word & ~after) + 1
        # The word's bytes as a polynomial, read off a running sum and moved to a common power.
        terms = _byte_codes(lower)[data] * _power(_BASE, len(data))
        total = np.cumsum(terms)
        h = total[self.end - 1] - total[self.start] + terms[self.start]
        self.hash = mix(h * _power(_UNDO, len(data))[self.start]) if len(self.start) else np.zeros(0, np.uint64)
        self.first = np.searchsorted(self.start, offsets)  # of each row; its length is one more than rows
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(offsets) - 1), self.count)


class Rolling:
    """Hashes of strings of a buffer, from a running sum."""

    def __init__(self, data: np.ndarray):
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_codes(False)[data] * _power(_BASE, len(data)), out=self.total[1:])
        self.undo = _power(_UNDO, len(data) + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.undo[start] + (end - start).astype(np.uint64))


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of k words inside one text, and the index of its first word."""
    n = len(words.hash)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        h = mix(h + words.hash[i : n - k + 1 + i] + np.uint64(2 * i + 1))
    at = np.flatnonzero(words.row[: n - k + 1] == words.row[k - 1 :])
    return h[at], at


def arrow_type(ddl: str):
    """Arrow schema of a DDL text."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def over_texts(docs: DataFrame, work: Callable, ddl: str, text: str = "text") -> DataFrame:
    """Applies ``work(slice, bytes, offsets) -> dict of columns`` to bounded slices of the rows."""
    schema = arrow_type(ddl)

    def run(batches):
        for part, data, offsets in rounds(batches, text):
            columns = work(part, data, offsets)
            yield pa.RecordBatch.from_arrays(
                [v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, type=f.type) for v, f in ((columns[f.name], f) for f in schema)],
                schema=schema,
            )

    return docs.mapInArrow(run, ddl)


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of the graph given by ``a, b`` (longs): the smallest node that is reachable.

    Alternates between linking larger neighbours and smaller neighbours to the smallest one until
    nothing changes.  Every round is written to the checkpoint folder.  No row depends on how large
    a component is: the minimum of a node is a partial aggregate, and the join of its edges can be
    split.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def mark(df: DataFrame):
        # A sum of hashes that does not depend on the order of the rows.
        return tuple(df.agg(F.count("*"), F.sum((F.xxhash64("a", "b") % 1_000_000_007).cast("decimal(38,0)"))).first())

    old = mark(edges)
    while old[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = cut(small.where("a <> b").distinct())
        new = mark(edges)
        if new == old:
            break
        old = new
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def packed(docs: DataFrame) -> DataFrame:
    """Rows as one struct ``doc``, beside ``doc_id`` and a hash ``tie`` of the text: no name of theirs can clash."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"))
