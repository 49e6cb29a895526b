"""Path filters, change sets and memory documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from codemem.functions import text as tx
from codemem.operators.joins import sized_join
from codemem.sources.ignore import IgnoreRule, ignored_paths, is_ignored

# Folder names skipped at any depth.
IGNORED_DIRS = (
    ".git",
    ".github",
    "__pycache__",
    ".venv",
    "venv",
    "env",
    "node_modules",
    ".cognee_store",
    ".pytest_cache",
    "dist",
    "build",
    "eggs",
    ".eggs",
)

# Suffixes (lower case) and exact file names that count as text.
TEXT_SUFFIXES = (
    ".py", ".md", ".txt", ".js", ".ts", ".html", ".css",
    ".json", ".yaml", ".yml", ".ini", ".toml", ".sh", ".bat",
)
EXPLICIT_FILES = (
    "requirements.txt",
    "setup.py",
    "package.json",
    "Dockerfile",
    "Makefile",
    "LICENSE",
    "gitignore",
    ".gitignore",
    ".env.example",
)

DATASET_PREFIX = "codemem_"


def outside_ignored_dirs(files: DataFrame, path: str = "path", names: Sequence[str] = IGNORED_DIRS) -> DataFrame:
    """Drop files below a folder with one of the names; a file of that name stays."""
    parts = F.split(F.col(path), "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return files.filter(~F.arrays_overlap(folders, F.array(*[F.lit(n) for n in names])))


def text_files(
    files: DataFrame,
    path: str = "path",
    suffixes: Sequence[str] = TEXT_SUFFIXES,
    names: Sequence[str] = EXPLICIT_FILES,
) -> DataFrame:
    return files.filter(
        tx.suffix(F.col(path)).isin(*suffixes) | tx.base_name(F.col(path)).isin(*names)
    )


def not_ignored(files: DataFrame, rules: Sequence[IgnoreRule], path: str = "path") -> DataFrame:
    return files.filter(~is_ignored(F.col(path), rules))


def not_ignored_by_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files that the rules of their own repository, a table as of ``ignore.rule_rows``, leave."""
    return sized_join(files, ignored_paths(files, rules), ["repo", "path"], "left_anti")


def substantial_files(files: DataFrame, content: str = "content") -> DataFrame:
    """Drop files with fewer than 15 characters of stripped text (before redaction)."""
    return files.filter(tx.is_substantial(F.col(content)))


def decode_utf8(files: DataFrame, raw: str = "raw", out: str = "content") -> DataFrame:
    """Bytes to text: invalid bytes dropped, line ends made ``\\n``.

    Valid rows stay in the JVM; only the others visit a Python worker.
    """
    as_text = F.col(raw).cast("string")
    keep = [c for c in files.columns if c != raw]
    valid = files.filter(F.is_valid_utf8(as_text)).select(*keep, as_text.alias(out))
    broken = files.filter(~F.is_valid_utf8(as_text))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in broken.schema if f.name != raw]

    def drop_invalid(frames):
        for frame in frames:
            frame[out] = [bytes(b).decode("utf-8", errors="ignore") for b in frame.pop(raw)]
            yield frame

    repaired = broken.mapInPandas(drop_invalid, ", ".join([*fields, f"`{out}` STRING"]))
    both = valid.unionByName(repaired)
    return both.withColumn(out, tx.universal_newlines(F.col(out)))


def dataset_name(folder: Column, prefix: str = DATASET_PREFIX) -> Column:
    """Dataset of a project folder: its lower-cased base name with ``-`` and blanks as ``_``."""
    base = F.regexp_extract(folder, r"([^/]+)/*$", 1)
    return F.concat(F.lit(prefix), F.translate(F.lower(base), "- ", "__"))


def legacy_dataset_name(path: Column) -> Column:
    return F.translate(path, "/\\. ", "____")


def tagged_document(path: Column, summary: Column, content: Column) -> Column:
    """Memory document of a file: path line, symbol summary, rule, content."""
    return F.concat(F.lit("File Path: "), path, F.lit("\n"), summary, F.lit("\n---\n"), content)


def changed_files(status: DataFrame) -> DataFrame:
    """Changed paths per repository.

    ``status(repo, a_path, b_path, area)`` lists workspace changes (``unstaged``,
    ``staged``, ``untracked``) and the files of the last commit (``last_commit``).
    The last commit counts only where the workspace has no change at all.
    """
    path = F.coalesce(F.nullif(F.col("b_path"), F.lit("")), F.nullif(F.col("a_path"), F.lit("")))
    flagged = status.select(
        "repo",
        F.replace(path, F.lit("\\"), F.lit("/")).alias("path"),
        (F.col("area") != "last_commit").alias("in_workspace"),
    ).filter(F.col("path").isNotNull())
    # One row per path after map-side combining; then one row per repository.
    per_path = flagged.groupBy("repo", "path").agg(F.max("in_workspace").alias("in_workspace"))
    dirty = flagged.filter("in_workspace").select("repo").distinct()
    from_workspace = per_path.filter("in_workspace").select("repo", "path")
    from_commit = sized_join(
        per_path.filter(~F.col("in_workspace")).select("repo", "path"), dirty, ["repo"], "left_anti"
    )
    return from_workspace.unionByName(from_commit)


def incremental_files(files: DataFrame, changes: DataFrame, on: Sequence[str] = ("repo", "path")) -> DataFrame:
    """Files whose path is in the change set."""
    return sized_join(files, changes.select(*on).distinct(), list(on), "left_semi")
