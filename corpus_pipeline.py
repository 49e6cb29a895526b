"""A corpus pipeline of five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before it kept.  What
a stage returns is written as Parquet to the shared folder and read again as the next one's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codemem.llm import bpe, mixing, neardup, outliers, secrets
from codemem.llm.common import stored, table
from codemem.llm.registry import TOKENIZER


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the robust distance rejects.

    Null, empty and very short texts have fewer than ten words and go; long texts are judged whole.  Rows
    that are repeated stay or go together; a null id, language or source is like any other.  No rows give
    no rows.  All columns come back as they are, whatever their names.
    """
    return outliers.keep_good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies: five words, 80 %.

    Null, empty and blank texts are near copies of nothing and stay; a text of fewer than five words is one
    shingle.  A row that is repeated is kept once; rows with a null id all stay.  No rows give no rows.  All
    columns come back as they are, whatever their names.
    """
    return neardup.keep_first(docs, k=5, percent=80)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets replaced by a mark; the network learns from the rows it is given.

    Null and empty texts stay as they are; long ones are read whole.  Repeated rows stay and are changed
    alike; ids do not matter.  No rows give no rows.  ``n_chars`` follows the text; other columns come back as
    they are, whatever their names.
    """
    return secrets.redacted(docs, secrets.train(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: one row for each pass over a document's source.

    Null, empty and blank texts have no words to take and leave.  Repeated rows and rows that share an id
    are taken each; a null source is a source; a long text may be taken in part, its pieces in order.  No rows
    give no rows.  ``n_chars`` follows the text; other columns come back as they are, whatever their names.
    """
    return mixing.mixed_documents(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text, one row for each row of the mix.

    Null and empty texts have no tokens; long ones are encoded whole.  Repeated rows give a row each; a null id
    stays null.  No rows give no rows; columns besides ``doc_id`` and ``text`` are not read.
    """
    return bpe.round_trip(docs, bpe.Vocabulary(spark, TOKENIZER))


STAGES = [
    ("quality rules", reject_poor),
    ("near-duplicates", drop_copies),
    ("secret scan", hide_secrets),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode_texts),
]

# The encoding and the mix cannot be said in SQL; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{k}")
    return docs
