"""The calls a user of the memory makes, each a composition of the jobs in this package."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from codemem.operators import files as fi, graph as gr, imports as im, memory as mem, symbols as sy
from codemem.plans import remember as rm
from codemem.plans.graph_store import GraphStore
from codemem.plans.store import MemoryStore
from codemem.session import Scratch
from codemem.sources import tree
from codemem.streaming.files import stream_files


class CodeMemory:
    """Memory of one or many repositories below one store folder."""

    def __init__(self, spark: SparkSession, root: str, embedder: mem.Embedder | None = None):
        self.spark = spark
        self.store = MemoryStore(spark, root, embedder)
        self.structure = GraphStore(spark, f"{self.store.root}/structure")

    def create(self) -> CodeMemory:
        self.store.create()
        self.structure.create()
        return self

    # ---- input ------------------------------------------------------------------------

    def scan(self, root: str, repo: str | None = None) -> DataFrame:
        """``files(repo, path, content)`` of a tree every executor can reach.

        What cannot be read, a file or a folder, has a row without content.
        """
        found = tree.read_tree(self.spark, root, repo)
        return found.select("repo", F.col("relative_path").alias("path"), "content")

    def scan_errors(self, root: str, repo: str | None = None) -> DataFrame:
        return tree.read_tree(self.spark, root, repo).filter(F.col("error").isNotNull()).drop("content")

    # ---- writing ----------------------------------------------------------------------

    def remember(
        self,
        files: DataFrame,
        commits: DataFrame | None = None,
        commit_files: DataFrame | None = None,
        changes: DataFrame | None = None,
        tag: str | None = None,
    ) -> None:
        """Store files, comments and commits; with ``changes(repo, path)`` only what changed.

        Documents stored before under the same ids are replaced; ``tag`` marks them for ``forget``.
        """
        with Scratch(self.spark) as scratch:
            docs = rm.remember(files, commits, commit_files, changes, scratch=scratch)
            self.store.ingest(docs.withColumn("tag", F.lit(tag).cast("string")), replace=True)

    def follow(self, root: str, checkpoint: str, repo: str | None = None, seconds: float | None = None, settle: float = 2) -> None:
        """Remember what was added to a tree or changed in it since the last call with this checkpoint.

        With ``seconds`` it goes on in that rhythm.  Files that vanish are left to ``refresh``.
        """
        found = tree.stream_tree(self.spark, root, repo, settle)
        stream_files(found.select("repo", F.col("relative_path").alias("path"), "content"), self.store, checkpoint, seconds)

    def refresh(self, files: DataFrame, commits: DataFrame | None = None, commit_files: DataFrame | None = None) -> None:
        """Bring the scanned repositories up to date; files that vanished are forgotten.

        History is only added to.  What a scan could not read (``content`` is null), and all
        below an unreadable folder, stays as it was.
        """
        with Scratch(self.spark) as scratch:
            files = scratch.written(files)  # a scan is read again by each use
            unread = files.filter(F.col("content").isNull()).select(fi.dataset_name(F.col("repo")).alias("dataset"), "path")
            docs = rm.remember(files.filter(F.col("content").isNotNull()), commits, commit_files, scratch=scratch)
            named = [r["dataset"] for r in files.select(fi.dataset_name(F.col("repo")).alias("dataset")).distinct().collect()]
            self.store.refresh(docs, named, kinds=("file", "comment"), unread=unread)

    def log(self, decision: str) -> None:
        self.store.log_decision(decision)

    def forget(
        self,
        file: str | DataFrame | None = None,
        dataset: str | None = None,
        tag: str | None = None,
        everything: bool = False,
        loose: bool = False,
    ) -> None:
        """Forget a file or a table ``path`` of files (``loose``: whatever mentions the file), a dataset, a tag, or all."""
        if everything:
            self.store.forget_all()
        elif dataset:
            self.store.forget_dataset(dataset)
        elif tag:
            self.store.forget_tags([tag])
        elif isinstance(file, DataFrame):
            self.store.forget_files(file)
        elif file and loose:
            self.store.forget_file_substring(file)
        elif file:
            self.store.forget_files([file])
        else:
            raise ValueError("name a file or a dataset, or say everything")

    # ---- asking -----------------------------------------------------------------------

    def search(self, query: str, k: int = mem.DEFAULT_K, datasets: Sequence[str] | None = None) -> DataFrame:
        return self.store.recall(query, k, datasets)

    def ask(self, query: str, k: int = mem.DEFAULT_K, datasets: Sequence[str] | None = None) -> str:
        """The distinct texts of the top k, a blank line between them."""
        if not query:
            raise ValueError("a query cannot be empty")
        return mem.answer_text(self.search(query, k, datasets)).first()["answer"]

    def ask_with_graph(self, query: str, symbols: DataFrame, k: int = mem.DEFAULT_K, datasets: Sequence[str] | None = None) -> DataFrame:
        """The symbols of the files that the best chunks come from: ``rank, repo, file, id, grp, label``."""
        repos = symbols.select("repo", fi.dataset_name(F.col("repo")).alias("dataset")).distinct()
        hits = self.search(query, k, datasets).join(repos, "dataset")
        return mem.with_graph(hits, gr.graph_edges(symbols), gr.graph_nodes(symbols))

    def ask_many(self, queries: DataFrame, k: int = mem.DEFAULT_K, datasets: Sequence[str] | None = None) -> DataFrame:
        return self.store.recall_batch(queries, k, datasets)

    def datasets(self) -> DataFrame:
        return mem.list_datasets(self.store.docs())

    def status(self) -> DataFrame:
        return mem.memory_status(self.store.docs())

    def decisions(self, n: int = 20) -> DataFrame:
        logged = self.store.docs().filter(F.col("scope") == mem.DECISION_DATASET.rstrip("_"))
        recent = logged.select(F.col("doc_id").alias("id"), F.col("ingested_at").alias("ts"), "dataset", "text")
        return mem.recent_decisions(recent, n)

    # ---- structure --------------------------------------------------------------------

    def refresh_structure(self, files: DataFrame, repos: Sequence[str] | None = None) -> None:
        """Bring the stored graph up to date with a scan; only new and different files are parsed.

        ``structure`` then gives its symbols, nodes, edges, counters, digest and imports.
        """
        self.structure.refresh(files, repos)

    @staticmethod
    def symbols(files: DataFrame) -> DataFrame:
        """Symbol table of a scan.  Write it out before building several views on it."""
        return sy.extract_symbols(rm.scanned_files(files).select("repo", "path", "content"))

    @staticmethod
    def graph(symbols: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Nodes, edges and the five counters."""
        return gr.graph_nodes(symbols), gr.graph_edges(symbols), gr.graph_stats(symbols)

    @staticmethod
    def import_edges(symbols: DataFrame) -> DataFrame:
        """``repo, path, module, target, inside``.  Write it out before walking it more than once."""
        return im.import_edges(symbols, sy.import_rows(symbols, ("repo", "path")))

    @staticmethod
    def importers(symbols: DataFrame, module: str, indirect: bool = False) -> DataFrame:
        """Files that import a module; with ``indirect`` a file's or outside module's importers at any distance."""
        if not indirect:
            return gr.importers_of(sy.import_rows(symbols, ("repo", "path")), module)
        edges = CodeMemory.import_edges(symbols)
        asked = edges.filter((F.col("target") == module) | (F.col("module") == module)).select("repo", "target")
        return im.importers_closure(edges, asked)

    def ask_with_imports(self, query: str, symbols: DataFrame, k: int = mem.DEFAULT_K, hops: int = 2, datasets: Sequence[str] | None = None) -> DataFrame:
        """The best chunks' files and those up to ``hops`` imports away: ``rank, repo, file, hops, via``."""
        repos = symbols.select("repo", fi.dataset_name(F.col("repo")).alias("dataset")).distinct()
        hits = self.search(query, k, datasets).filter(F.col("path").isNotNull()).join(repos, "dataset")
        return im.import_neighbours(hits.select("rank", "repo", "path"), self.import_edges(symbols), hops)

    @staticmethod
    def write_graph(symbols: DataFrame, out: str) -> None:
        """One JSON object per node and edge, as text files."""
        nodes = gr.node_json(gr.graph_nodes(symbols)).select(F.lit("node").alias("of"), F.col("json").alias("value"))
        edges = gr.edge_json(gr.graph_edges(symbols)).select(F.lit("edge").alias("of"), F.col("json").alias("value"))
        nodes.unionByName(edges).write.mode("overwrite").partitionBy("of").text(out)

    @staticmethod
    def write_digest(symbols: DataFrame, title: str, out: str) -> None:
        gr.write_digest(symbols, title, out)

    @staticmethod
    def changed(status: DataFrame) -> DataFrame:
        return fi.changed_files(status)
