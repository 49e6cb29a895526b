"""The memory on disk: documents and their chunks as plain Parquet tables.

Both tables are partitioned by scope (the dataset; all decisions share one) and part.  A part is a hash
bucket of the path, or the label of a source that only adds, such as a batch of a stream.  Storing,
refreshing and forgetting rewrite the buckets that change; a labelled part is written as it is, without
a look at what is stored.  Chunks are written first: a document counts as known once its chunks are
there, so a call that failed can be repeated and loses nothing.  One writer at a time.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codemem.functions import text as tx
from codemem.operators import memory as mem
from codemem.operators.joins import sized_join
from codemem.operators.snapshots import snapshot_diff
from codemem.plans import partitions as pt
from codemem.session import Scratch

DOCS = (
    "dataset STRING, doc_id STRING, kind STRING, path STRING, tag STRING, text STRING, sha256 STRING, "
    "ingested_at TIMESTAMP, scope STRING, part STRING"
)
CHUNKS = (
    "dataset STRING, doc_id STRING, kind STRING, path STRING, chunk_no BIGINT, text STRING, "
    "embedding ARRAY<FLOAT>, scope STRING, part STRING"
)
TABLES = {"docs": DOCS, "chunks": CHUNKS}
PARTITIONS = ("scope", "part")
ID = ("dataset", "doc_id")
BUCKETS = 4
DECISIONS = mem.DECISION_DATASET.rstrip("_")


def scope_of(dataset: Column) -> Column:
    """Partition of a dataset.  Decisions get one dataset per second and share a scope."""
    return F.when(F.startswith(dataset, F.lit(mem.DECISION_DATASET)), DECISIONS).otherwise(dataset)


def tag_of(docs: DataFrame) -> Column:
    """The optional column ``tag`` of documents."""
    return (F.col("tag") if "tag" in docs.columns else F.lit(None)).cast("string").alias("tag")


class MemoryStore:
    """``buckets`` is the number of parts a dataset is cut into; it has to stay the same for one folder."""

    def __init__(self, spark: SparkSession, root: str, embedder: mem.Embedder | None = None, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.embedder = embedder or mem.hash_embedder()

    def create(self) -> MemoryStore:
        """Open the memory below the root, or start one where there is none."""
        for table, schema in TABLES.items():
            if not pt.exists(self.spark, f"{self.root}/{table}"):
                pt.clear(self.spark, f"{self.root}/{table}", schema, PARTITIONS)
        return self

    # ---- reading ----------------------------------------------------------------------

    def _table(self, table: str) -> DataFrame:
        return pt.rows_of(self.spark, f"{self.root}/{table}", TABLES[table], "doc_id")

    def docs(self, datasets: Sequence[str] | None = None) -> DataFrame:
        return self._in_scope(self._table("docs"), datasets)

    def chunks(self, datasets: Sequence[str] | None = None) -> DataFrame:
        return self._in_scope(self._table("chunks"), datasets)

    @staticmethod
    def _in_scope(rows: DataFrame, datasets: Sequence[str] | None) -> DataFrame:
        if datasets is None:
            return rows
        scopes = {DECISIONS if d.startswith(mem.DECISION_DATASET) else d for d in datasets}
        return rows.filter(F.col("scope").isin(*sorted(scopes)) & F.col("dataset").isin(*datasets))

    def _recall_scope(self, datasets: Sequence[str] | None) -> DataFrame:
        rows = self._table("chunks")
        return rows if datasets is None else rows.filter(F.col("scope").isin(*datasets, DECISIONS))

    def recall(self, query: str, k: int = mem.DEFAULT_K, datasets: Sequence[str] | None = None) -> DataFrame:
        """Top k chunks; with datasets given, decisions are searched along with them.

        The first pass reads keys and vectors only.  The k winners' texts are then
        looked up by literal keys, which the scan can push down.
        """
        vector = mem.query_vector(self.spark, query, self.embedder)
        rows = self._recall_scope(datasets)
        keys = [*mem.CHUNK_KEY, *PARTITIONS]
        found = mem.recall(rows.drop("text"), vector, k).select("rank", "score", *keys).collect()
        schema = "rank BIGINT, score DOUBLE, dataset STRING, doc_id STRING, chunk_no BIGINT, scope STRING, part STRING"
        top = F.broadcast(self.spark.createDataFrame(found, schema))  # k rows
        for name in (*PARTITIONS, *ID):
            rows = rows.filter(F.col(name).isin(*{r[name] for r in found}))
        return rows.select(*keys, "kind", "path", "text").join(top, keys).drop(*PARTITIONS)

    def recall_batch(self, queries: DataFrame, k: int = mem.DEFAULT_K, datasets: Sequence[str] | None = None) -> DataFrame:
        """Top k of every ``queries(query_id, text)``, without the texts."""
        asked = self.embedder(queries.select("query_id", "text"))
        return mem.recall_batch(self._recall_scope(datasets).drop("text"), asked, k)

    # ---- writing ----------------------------------------------------------------------

    def _rows(self, scratch: Scratch, docs: DataFrame, label: str | None = None) -> DataFrame:
        """Documents as they are stored, made once: redacted, with hash, time and partition."""
        part = pt.bucket(self.buckets, F.col("dataset"), F.coalesce("path", "doc_id")) if label is None else F.lit(label)
        safe = docs.select(*ID, "kind", "path", tag_of(docs), tx.redact(F.col("text")).alias("text"))
        rows = safe.select(
            "*", F.sha2("text", 256).alias("sha256"), F.current_timestamp().alias("ingested_at"),
            scope_of(F.col("dataset")).alias("scope"), part.alias("part"),
        )
        return scratch.written(rows)

    def _put(self, scratch: Scratch, new: DataFrame, gone: DataFrame | None = None) -> None:
        """Store written ``new`` rows and leave out the ``gone`` ones ``(dataset, doc_id, scope, part)``.

        Without ``gone`` the parts of the new rows are theirs alone.
        """
        touched = new.select(*PARTITIONS)
        if gone is not None:
            # Also the new ids: an earlier call may have stored their chunks and then failed.
            gone = scratch.written(gone.select(*ID, *PARTITIONS).unionByName(new.select(*ID, *PARTITIONS)).distinct())
            touched = gone.select(*PARTITIONS)
        touched = scratch.written(touched.distinct())
        names = pt.names(touched, PARTITIONS)
        if not names["part"]:
            return
        # Documents are dealt to their partitions before they are embedded: texts move, vectors do not.
        made = {"chunks": self.embedder(mem.chunk_documents(pt.dealt(new.drop("tag", "sha256", "ingested_at"), PARTITIONS))), "docs": pt.dealt(new, PARTITIONS)}
        # Documents without a word have no chunks, so they do not replace a partition of them.
        filled = {"chunks": new.filter(F.col("doc_id").isNotNull() & (tx.strip_ws(F.col("text")) != "")), "docs": new}
        for table in ("chunks", "docs"):
            kept = self._table(table).limit(0)
            if gone is not None:
                kept = sized_join(pt.inside(self._table(table), touched, names), gone, [*ID, *PARTITIONS], "left_anti")
            empty = sized_join(touched, filled[table].select(*PARTITIONS).distinct(), list(PARTITIONS), "left_anti")
            pt.replace(kept, f"{self.root}/{table}", TABLES[table], empty, PARTITIONS, ["doc_id"], made[table])

    def ingest(self, docs: DataFrame, replace: bool = False, label: str | None = None) -> None:
        """Store documents and their chunks; documents of the same ids are replaced.

        With ``replace``, whatever else was stored of their paths is forgotten too.  A ``label`` names what is
        stored as a part of its own, which a repeated call writes again; it compares nothing with
        what is there, so its cost does not grow with the memory.
        """
        with Scratch(self.spark) as scratch:
            new = self._rows(scratch, docs, label)
            if label is not None:
                return self._put(scratch, new)
            held = sized_join(self._table("docs").select(*ID, "path", *PARTITIONS), new.select("scope").distinct(), ["scope"], "left_semi")
            gone = sized_join(held, new.select(*ID), list(ID), "left_semi")
            if replace:
                paths = new.filter(F.col("path").isNotNull()).select("dataset", "path").distinct()
                gone = gone.unionByName(sized_join(held, paths, ["dataset", "path"], "left_semi"))
            self._put(scratch, new, gone)

    def refresh(
        self,
        docs: DataFrame,
        datasets: Sequence[str] | None = None,
        kinds: Sequence[str] | None = None,
        unread: DataFrame | None = None,
    ) -> None:
        """Make the datasets hold exactly ``docs``; unchanged documents are left alone.

        By default those are the datasets that occur in ``docs``; a list spares the
        store the scan of all others, and empties those that do not occur.  Only
        documents of ``kinds`` (default: all) are forgotten for being absent, and none
        at or below a path of ``unread(dataset, path)``: it could not be looked at.

        The documents are made once, and written; keys and hashes are compared.
        """
        with Scratch(self.spark) as scratch:
            made = self._rows(scratch, docs)
            held = self.docs(datasets).select(*ID, "kind", "path", "sha256", *PARTITIONS)
            if datasets is None:
                held = sized_join(held, made.select("dataset").distinct(), ["dataset"], "left_semi")
            diff = snapshot_diff(held.select(*ID, "sha256"), made.select(*ID, "sha256"), ID, "sha256")
            # Written out: the decision must not be taken again after the store has changed.
            changed = scratch.written(diff.filter(F.col("change_type") != "unchanged"))
            old = sized_join(held, changed, list(ID), "inner")
            absent = old.filter("change_type = 'deleted'")
            if kinds is not None:
                absent = absent.filter(F.col("kind").isin(*kinds))
            if unread is not None:
                below = F.concat(F.regexp_replace("u.path", "/$", ""), F.lit("/"))
                inside = (F.col("a.path") == F.col("u.path")) | F.startswith(F.col("a.path"), below) | F.col("u.path").isin("", ".")
                absent = absent.alias("a").join(unread.alias("u"), (F.col("a.dataset") == F.col("u.dataset")) & F.coalesce(inside, F.lit(False)), "left_anti")
            gone = absent.unionByName(old.filter("change_type = 'modified'"))
            fresh = changed.filter(F.col("change_type") != "deleted").select(*ID)
            self._put(scratch, scratch.written(sized_join(made, fresh, list(ID), "left_semi")), gone)

    def log_decision(self, text: str, at: int | None = None) -> None:
        """Store one decision; ``at`` is epoch seconds."""
        if not text:
            raise ValueError("a decision cannot be empty")
        at, number = at or int(time.time()), time.time_ns()
        one = self.spark.createDataFrame([(number, text)], "id BIGINT, text STRING")
        self.ingest(mem.decision_docs(one.withColumn("ts", F.timestamp_seconds(F.lit(at)))), label=f"decision-{number}")

    def settle(self) -> None:
        """Move what was stored under labels into the hash buckets, so that small parts do not pile up."""
        loose = self._table("docs").filter(~F.rlike("part", F.lit("^[0-9]+$")))
        part = pt.bucket(self.buckets, F.col("dataset"), F.coalesce("path", "doc_id"))
        with Scratch(self.spark) as scratch:
            loose = scratch.written(loose)
            self._put(scratch, scratch.written(loose.withColumn("part", part)), loose)

    # ---- forgetting -------------------------------------------------------------------

    def _forget(self, gone: DataFrame) -> None:
        with Scratch(self.spark) as scratch:
            self._put(scratch, self.spark.createDataFrame([], DOCS), gone)

    def forget_dataset(self, name: str) -> None:
        """An unknown name is no error."""
        self._forget(self.docs([name]))

    def forget_files(self, paths: Sequence[str] | DataFrame) -> None:
        """Documents of exactly these paths, of every kind and dataset; ``paths`` is a list or a table ``path``."""
        rows = self._table("docs")
        if isinstance(paths, DataFrame):
            self._forget(sized_join(rows, paths.select("path").distinct(), ["path"], "left_semi"))
        else:
            self._forget(rows.filter(F.col("path").isin(*paths)))

    def forget_tags(self, tags: Sequence[str]) -> None:
        """Documents with one of these tags."""
        self._forget(self._table("docs").filter(F.col("tag").isin(*tags)))

    def forget_file_substring(self, path: str) -> None:
        """Every document that mentions the path, and the dataset named after it."""
        named = F.col("dataset") == path.translate(str.maketrans("/\\. ", "____"))
        self._forget(self._table("docs").filter(mem.mentions_file(path, F.col("text"), F.col("path")) | named))

    def forget_all(self) -> None:
        for table, schema in TABLES.items():
            pt.clear(self.spark, f"{self.root}/{table}", schema, PARTITIONS)
