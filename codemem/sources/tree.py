"""Scan of a source tree: list on executors, then read on executors.

Spark's own file sources skip names that start with ``.`` or ``_``; source trees
are full of them, so the listing is a Python data source.  It yields names and
sizes only.  Contents are read in a second stage after a shuffle of those names,
so a folder that holds a third of the tree is still read by many tasks.
"""

from __future__ import annotations

import os
import re
import time
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from codemem.operators.files import EXPLICIT_FILES, IGNORED_DIRS, TEXT_SUFFIXES
from codemem.session import mounted
from codemem.sources.ignore import compile_rules

LISTING_SCHEMA = "repo STRING, root STRING, relative_path STRING, size BIGINT, error STRING"
RAW_SCHEMA = "repo STRING, relative_path STRING, content STRING, error STRING"
BATCH_BYTES = 16 << 20


class TreeSlice(InputPartition):
    """Folders to list, each with a flag: with everything below it, or only its own files."""

    def __init__(self, folders: list[tuple[str, bool]]):
        self.folders = folders


class TreeReader(DataSourceReader):
    def __init__(self, root: str, repo: str, slices: int, suffixes: Sequence[str]):
        self.root = os.path.abspath(root)
        self.repo = repo
        self.slices = slices
        self.suffixes = frozenset(suffixes)
        rule_file = os.path.join(self.root, ".gitignore")
        patterns: list[str] = []
        if os.path.exists(rule_file):
            with open(rule_file, encoding="utf-8", errors="ignore") as handle:
                patterns = handle.readlines()
        self.rules = [(rule.regex, rule.negated) for rule in compile_rules(patterns)]

    def _ignored(self, name: str) -> bool:
        for regex, negated in reversed(self.rules):
            if re.search(regex, name):
                return not negated
        return False

    def _relative(self, path: str) -> str:
        return os.path.relpath(path, self.root).replace(os.sep, "/")

    def _list(self, folder: str) -> tuple[list[str], list[os.DirEntry]]:
        """Sub-folders to enter and files to keep."""
        folders, files = [], []
        with os.scandir(folder) as entries:
            for entry in entries:
                name = self._relative(entry.path)
                if entry.is_dir():
                    if not (entry.is_symlink() or entry.name in IGNORED_DIRS or self._ignored(name + "/")):
                        folders.append(entry.path)
                    continue
                stem_dot = entry.name.rfind(".")
                ending = entry.name[stem_dot:].lower() if stem_dot > 0 else ""
                if (ending in self.suffixes or entry.name in EXPLICIT_FILES) and not self._ignored(name):
                    files.append(entry)
        return folders, files

    def partitions(self) -> list[TreeSlice]:
        # The driver opens folders only until there are enough of them to hand out.
        open_folders, own_files_only = [self.root], []
        while open_folders and len(open_folders) + len(own_files_only) < self.slices:
            folder = open_folders.pop(0)
            try:
                below, _ = self._list(folder)
            except OSError:
                below = []
            own_files_only.append((folder, False))
            open_folders.extend(below)
        work = own_files_only + [(folder, True) for folder in open_folders]
        return [TreeSlice([item]) for item in work]

    def read(self, partition: TreeSlice) -> Iterator[tuple]:
        for top, below_too in partition.folders:
            stack = [top]
            while stack:
                folder = stack.pop()
                try:
                    below, files = self._list(folder)
                except OSError as problem:
                    yield (self.repo, self.root, self._relative(folder), None, str(problem))
                    continue
                if below_too:
                    stack.extend(below)
                for entry in files:
                    try:
                        size = entry.stat().st_size
                    except OSError:
                        size = None
                    yield (self.repo, self.root, self._relative(entry.path), size, None)


class ChangedSlice(InputPartition):
    """Folders to list for files that changed after one time and not after another."""

    def __init__(self, part: TreeSlice, after: int, until: int):
        self.part, self.after, self.until = part, after, until


class TreeStreamReader(DataSourceStreamReader):
    """Files of a tree as they are added and changed.

    An offset is a time of the file system, so nothing has to be remembered about files: a batch is what
    changed after the last offset and not after this one.  A file's change time is set by the
    system when its content is written and when it is moved here.  Offsets stay ``settle``
    seconds behind the clock, so that a write in progress falls into a later batch as a whole.
    """

    def __init__(self, reader: TreeReader, settle: float):
        self.reader, self.settle = reader, settle

    def initialOffset(self) -> dict:
        return {"time": 0}

    def latestOffset(self) -> dict:
        return {"time": time.time_ns() - int(self.settle * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[ChangedSlice]:
        return [ChangedSlice(part, start["time"], end["time"]) for part in self.reader.partitions()]

    def read(self, partition: ChangedSlice) -> Iterator[tuple]:
        for row in self.reader.read(partition.part):
            if row[-1] is not None:
                continue  # a folder that cannot be listed now has its files in no batch
            try:
                changed = os.stat(os.path.join(row[1], row[2])).st_ctime_ns
            except OSError:
                continue
            if partition.after < changed <= partition.until:
                yield row

    def commit(self, end: dict) -> None:
        """Nothing is kept, so nothing is let go."""


class TreeListing(DataSource):
    """``spark.read.format("codetree").option("root", …)``: one row per file to index."""

    @classmethod
    def name(cls) -> str:
        return "codetree"

    def schema(self) -> str:
        return LISTING_SCHEMA

    def reader(self, schema) -> TreeReader:
        root = self.options["root"]
        return TreeReader(
            root,
            self.options.get("repo") or os.path.basename(os.path.abspath(root)),
            int(self.options.get("slices", 64)),
            self.options.get("suffixes", ",".join(TEXT_SUFFIXES)).split(","),
        )

    def streamReader(self, schema) -> TreeStreamReader:
        return TreeStreamReader(self.reader(schema), float(self.options.get("settle", 2)))


def _listing(
    spark: SparkSession, reader, root: str, repo: str | None = None, slices: int | None = None, suffixes: Sequence[str] = TEXT_SUFFIXES
) -> DataFrame:
    spark.dataSource.register(TreeListing)
    root = mounted(root)
    slices = slices or max(64, 4 * spark.sparkContext.defaultParallelism)
    return (
        reader.format("codetree")
        .option("root", root)
        .option("repo", repo or os.path.basename(os.path.abspath(root)))
        .option("slices", str(slices))
        .option("suffixes", ",".join(suffixes))
        .load()
    )


def list_tree(spark: SparkSession, root: str, repo: str | None = None, slices: int | None = None, suffixes: Sequence[str] = TEXT_SUFFIXES) -> DataFrame:
    """Listing of a tree in ``slices`` tasks, by default a few for each core of the cluster."""
    return _listing(spark, spark.read, root, repo, slices, suffixes)


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = pa.schema([(n, pa.string()) for n in ("repo", "relative_path", "content", "error")])
    rows: list[tuple] = []
    held = 0
    flush = lambda: pa.RecordBatch.from_arrays(
        [pa.array(column, pa.string()) for column in zip(*rows)], schema=fields
    )
    for batch in batches:
        for row in batch.to_pylist():
            content, error = None, row["error"]
            if error is None:
                try:
                    with open(os.path.join(row["root"], row["relative_path"]), "rb") as handle:
                        content = handle.read().decode("utf-8", errors="ignore")
                    content = content.replace("\r\n", "\n").replace("\r", "\n")
                except OSError as problem:
                    error = str(problem)
            rows.append((row["repo"], row["relative_path"], content, error))
            held += len(content or "")
            if held >= BATCH_BYTES:
                yield flush()
                rows, held = [], 0
    if rows:
        yield flush()


def read_tree(
    spark: SparkSession,
    root: str,
    repo: str | None = None,
    slices: int | None = None,
    read_tasks: int | None = None,
    suffixes: Sequence[str] = TEXT_SUFFIXES,
) -> DataFrame:
    """Files of a tree with their text; unreadable ones carry ``error`` and no content.

    The number of reading tasks is explicit: left to the adaptive planner, a
    listing of a few megabytes would be read by one task.
    """
    tasks = read_tasks or max(32, 4 * spark.sparkContext.defaultParallelism)
    listing = list_tree(spark, root, repo, slices, suffixes)
    return listing.repartition(tasks, "relative_path").mapInArrow(_read_batches, RAW_SCHEMA)


def stream_tree(spark: SparkSession, root: str, repo: str | None = None, settle: float = 2, read_tasks: int | None = None) -> DataFrame:
    """Stream of a tree's files with their text, as they are added and changed; removed ones do not show."""
    tasks = read_tasks or max(32, 4 * spark.sparkContext.defaultParallelism)
    listing = _listing(spark, spark.readStream.option("settle", str(settle)), root, repo)
    return listing.repartition(tasks, "relative_path").mapInArrow(_read_batches, RAW_SCHEMA)
