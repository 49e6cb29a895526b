"""A stored graph of files, classes, functions and imports, kept up to date by what has changed.

What is stored is one nested row of symbols per file, in hash buckets of (repository, path).  Nodes, edges,
counters, the digest and the import graph are columns computed from those rows without parsing
anything, so they cannot disagree with each other.  A refresh compares hashes, parses the files that
are new or different, and rewrites the buckets that hold them or files that are gone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from codemem.functions import text as tx
from codemem.operators import files as fi, graph as gr, imports as im, symbols as sy
from codemem.operators.joins import sized_join
from codemem.operators.snapshots import snapshot_diff
from codemem.plans import partitions as pt
from codemem.schema import SYMBOL_COLUMNS
from codemem.session import Scratch

KEY = ("repo", "path")
PARTITIONS = ("owner", "part")
SYMBOLS = f"repo STRING, path STRING, {SYMBOL_COLUMNS}, sha256 STRING, owner STRING, part STRING"
BUCKETS = 4


class GraphStore:
    """``buckets`` is the number of parts a repository is cut into; it has to stay the same for one folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def create(self) -> GraphStore:
        """Open the graph below the root, or start one where there is none."""
        if not pt.exists(self.spark, self.root):
            pt.clear(self.spark, self.root, SYMBOLS, PARTITIONS)
        return self

    # ---- reading ----------------------------------------------------------------------

    def _rows(self) -> DataFrame:
        return pt.rows_of(self.spark, self.root, SYMBOLS, "path")

    def symbols(self, repos: Sequence[str] | None = None) -> DataFrame:
        rows = self._rows()
        rows = rows if repos is None else rows.filter(F.col("owner").isin(*repos))
        return rows.drop("sha256", *PARTITIONS)

    def nodes(self, repos: Sequence[str] | None = None) -> DataFrame:
        return gr.graph_nodes(self.symbols(repos))

    def edges(self, repos: Sequence[str] | None = None) -> DataFrame:
        return gr.graph_edges(self.symbols(repos))

    def stats(self, repos: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
        return gr.graph_stats(self.symbols(repos), by)

    def digest(self, repos: Sequence[str] | None = None) -> DataFrame:
        return gr.digest_rows(self.symbols(repos))

    def imports(self, repos: Sequence[str] | None = None) -> DataFrame:
        """``repo, path, module, target, inside``."""
        symbols = self.symbols(repos)
        return im.import_edges(symbols, sy.import_rows(symbols, KEY))

    # ---- writing ----------------------------------------------------------------------

    def refresh(self, files: DataFrame, repos: Sequence[str] | None = None) -> None:
        """Make the graph of the scanned repositories equal to the scan ``files(repo, path, content)``.

        ``repos`` names the repositories that were scanned; by default those that occur in ``files``.  What
        could not be read (``content`` is null), and all below an unreadable folder, stays as it was.
        """
        with Scratch(self.spark) as scratch:
            scan = scratch.written(fi.substantial_files(files).select(*KEY, "content", F.sha2("content", 256).alias("sha256")))
            held = self._rows().select(*KEY, "sha256", *PARTITIONS)
            if repos is None:
                seen = files.select("repo").distinct()
                held = sized_join(held, seen, ["repo"], "left_semi")
            else:
                held = held.filter(F.col("owner").isin(*repos))
            diff = snapshot_diff(held.select(*KEY, "sha256"), scan.select(*KEY, "sha256"), KEY, "sha256")
            changed = scratch.written(diff.filter(F.col("change_type") != "unchanged"))
            old = sized_join(held, changed, list(KEY), "inner")
            unread = files.filter(F.col("content").isNull()).select(*KEY).distinct()
            below = F.concat(F.regexp_replace("u.path", "/$", ""), F.lit("/"))
            inside = (F.col("o.path") == F.col("u.path")) | F.startswith(F.col("o.path"), below) | F.col("u.path").isin("", ".")
            kept = (F.col("o.repo") == F.col("u.repo")) & (F.col("o.change_type") == "deleted") & inside
            gone = old.alias("o").join(unread.alias("u"), kept, "left_anti").select(*KEY, *PARTITIONS)
            self._put(scratch, sized_join(scan, changed.filter(F.col("change_type") != "deleted").select(*KEY), list(KEY), "left_semi"), gone)

    def _put(self, scratch: Scratch, fresh: DataFrame, gone: DataFrame) -> None:
        """Parse the ``fresh`` files, and only those, and rewrite the parts they or ``gone`` ones are in."""
        clean = fresh.withColumn("content", tx.redact(F.col("content")))
        made = sy.extract_symbols(clean).withColumn("owner", F.col("repo"))
        made = scratch.written(made.withColumn("part", pt.bucket(self.buckets, F.col("repo"), F.col("path"))))
        gone = scratch.written(gone.unionByName(made.select(*KEY, *PARTITIONS)).distinct())
        touched = scratch.written(gone.select(*PARTITIONS).distinct())
        names = pt.names(touched, PARTITIONS)
        if names["part"]:
            kept = sized_join(pt.inside(self._rows(), touched, names), gone, [*KEY, *PARTITIONS], "left_anti")
            pt.replace(kept.unionByName(made), self.root, SYMBOLS, touched, PARTITIONS, ["path"])

    def forget_files(self, paths: DataFrame) -> None:
        """Leave out the files of ``paths(repo, path)``."""
        gone = sized_join(self._rows().select(*KEY, *PARTITIONS), paths.select(*KEY).distinct(), list(KEY), "left_semi")
        with Scratch(self.spark) as scratch:
            self._put(scratch, self.spark.createDataFrame([], "repo STRING, path STRING, content STRING, sha256 STRING"), gone)
