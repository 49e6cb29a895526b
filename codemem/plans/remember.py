"""The ingest pipeline: files, commits and comments as documents of one store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from codemem.functions import text as tx
from codemem.operators import comments as cm, commits as ci, files as fi, symbols as sy
from codemem.session import Scratch


def scanned_files(files: DataFrame) -> DataFrame:
    """Files worth indexing, redacted."""
    return fi.substantial_files(files).withColumn("content", tx.redact(F.col("content")))


def file_documents(files: DataFrame, dataset: Column) -> DataFrame:
    """Tagged text per file: path line, symbol outline, content (after redaction)."""
    clean = scanned_files(files).select("repo", "path", "content", F.col("content").alias("body"))
    described = sy.extract_symbols(clean)
    return described.select(
        dataset.alias("dataset"),
        F.concat(F.lit("file:"), "path").alias("doc_id"),
        F.lit("file").alias("kind"),
        "path",
        fi.tagged_document(F.col("path"), sy.summary_text(F.col("path")), F.col("body")).alias("text"),
    )


def comment_documents(files: DataFrame, dataset: Column) -> DataFrame:
    logs = cm.comment_logs(fi.substantial_files(files), ("repo", "path"))
    return logs.select(
        dataset.alias("dataset"),
        F.concat(F.lit("comments:"), "path").alias("doc_id"),
        F.lit("comment").alias("kind"),
        "path",
        "text",
    )


def commit_documents(
    commits: DataFrame, commit_files: DataFrame, dataset: Column, n: int | None = None
) -> DataFrame:
    """Texts of all commits, or of the ``n`` newest of each repository, with whole patches."""
    texts = ci.commit_docs(commits if n is None else ci.latest_commits(commits, n), commit_files)
    return texts.select(
        dataset.alias("dataset"),
        F.concat(F.lit("commit:"), "hash", F.lit(":"), F.col("part").cast("string")).alias("doc_id"),
        F.lit("commit").alias("kind"),
        F.lit(None).cast("string").alias("path"),
        "text",
    )


def remember(
    files: DataFrame,
    commits: DataFrame | None = None,
    commit_files: DataFrame | None = None,
    changes: DataFrame | None = None,
    dataset: Column | None = None,
    newest_commits: int | None = None,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Documents of a corpus; with ``changes`` only the files that changed.

    ``files(repo, path, content)`` is a scan.  The dataset defaults to the name
    derived from the repository's folder.  ``scratch`` is where the scan is written and
    removed from afterwards; without one it stays below the shared folder.
    """
    name = fi.dataset_name(F.col("repo")) if dataset is None else dataset
    chosen = files if changes is None else fi.incremental_files(files, changes)
    # The source is read once: files, Python files and comments each start from the written scan.
    chosen = (scratch or Scratch(files.sparkSession)).written(fi.substantial_files(chosen).select("repo", "path", "content"))
    docs = file_documents(chosen, name).unionByName(comment_documents(chosen, name))
    if commits is not None and commit_files is not None:
        docs = docs.unionByName(commit_documents(commits, commit_files, name, newest_commits))
    return docs
