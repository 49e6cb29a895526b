"""File/class/function graph and digest, computed row by row from the symbol table.

A file's symbols sit in its row, so ids are made unique inside the row and no
operator here shuffles; ``(repo, path)`` is unique in a scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from codemem.functions import text as tx
from codemem.operators.joins import sized_join
from codemem.operators.symbols import rows_of

# Shape and size per kind of node, the edge label, and the digest's lines.
NODE_SHAPES = {"file": ("dot", 22), "class": ("diamond", 16), "func": ("triangle", 12)}
EDGE_LABEL = "defines"
NO_SYMBOLS = "  - *(No top-level classes/functions extracted)*"
STAT_LABELS = {
    "total_files": "- **Indexable Files**: ",
    "total_classes": "- **Classes / Data Models**: ",
    "total_funcs": "- **Functions / Methods**: ",
    "total_nodes": "- **Graph Nodes**: ",
    "total_edges": "- **Graph Relationships**: ",
}


def _names(column: str) -> Column:
    """Distinct symbol names of a file in order of first appearance."""
    return F.array_distinct(F.transform(column, lambda s: s["name"]))


def _named(symbols: DataFrame, keys: Sequence[str]) -> DataFrame:
    return symbols.select(*keys, _names("classes").alias("class_names"), _names("functions").alias("func_names"))


def _node(grp: str, path: Column, id_: Column, label: Column, title: Column) -> Column:
    shape, size = NODE_SHAPES[grp]
    return F.struct(
        id_.alias("id"),
        F.lit(grp).alias("grp"),
        label.alias("label"),
        title.alias("title"),
        (path if grp == "file" else F.lit(None).cast("string")).alias("path"),
        F.lit(shape).alias("shape"),
        F.lit(size).alias("size"),
    )


def _symbol_id(grp: str, path: Column, name: Column) -> Column:
    return F.concat(F.lit(f"{grp}:"), path, F.lit(":"), name)


def graph_nodes(symbols: DataFrame, keys: Sequence[str] = ("repo", "path")) -> DataFrame:
    """``keys → file``: repo, file, pos, id, grp, label, title, path, shape, size.

    ``file`` is the path of the file a node belongs to; ``path`` is set on file nodes only.
    """
    path = F.col("path")
    of_file = _node(
        "file", path, F.concat(F.lit("file:"), path), tx.base_name(path), F.concat(F.lit("File: "), path)
    )
    of_class = lambda n: _node(
        "class", path, _symbol_id("class", path, n), F.concat(F.lit("Class "), n),
        F.concat(F.lit("Class "), n, F.lit(" in "), path),
    )
    of_func = lambda n: _node(
        "func", path, _symbol_id("func", path, n), F.concat(F.lit("fn "), n, F.lit("()")),
        F.concat(F.lit("Function "), n, F.lit(" in "), path),
    )
    nodes = F.concat(
        F.array(of_file), F.transform("class_names", of_class), F.transform("func_names", of_func)
    )
    carried = [F.col(k).alias("file") if k == "path" else F.col(k) for k in keys]
    made = _named(symbols, keys).select(*carried, nodes.alias("nodes"))
    names = ["file" if k == "path" else k for k in keys]
    return rows_of(made, "nodes", "n", "pos").select(*names, "pos", "n.*")


def graph_edges(symbols: DataFrame, keys: Sequence[str] = ("repo", "path")) -> DataFrame:
    path = F.col("path")
    edge = lambda grp: lambda n: F.struct(
        F.concat(F.lit("file:"), path).alias("src"),
        _symbol_id(grp, path, n).alias("dst"),
        F.lit(EDGE_LABEL).alias("label"),
    )
    edges = F.concat(F.transform("class_names", edge("class")), F.transform("func_names", edge("func")))
    carried = [F.col(k).alias("file") if k == "path" else F.col(k) for k in keys]
    made = _named(symbols, keys).select(*carried, edges.alias("edges"))
    names = ["file" if k == "path" else k for k in keys]
    return rows_of(made, "edges", "e").select(*names, "e.*")


def graph_stats(symbols: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Files, classes and functions before, nodes and edges after making ids unique."""
    counted = symbols.select(
        *by,
        F.size("classes").alias("classes"),
        F.size("functions").alias("funcs"),
        F.size(_names("classes")).alias("class_names"),
        F.size(_names("functions")).alias("func_names"),
    )
    symbols_total = F.coalesce(F.sum(F.col("class_names") + F.col("func_names")), F.lit(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return counted.groupBy(*by).agg(
        F.count("*").alias("total_files"),
        total("classes").alias("total_classes"),
        total("funcs").alias("total_funcs"),
        (F.count("*") + symbols_total).cast("bigint").alias("total_nodes"),
        symbols_total.cast("bigint").alias("total_edges"),
    )


def digest_rows(symbols: DataFrame, keys: Sequence[str] = ("repo", "path")) -> DataFrame:
    """One text section per file: heading, then its class and function labels."""
    items = F.concat(
        F.transform("class_names", lambda n: F.concat(F.lit("  - Class "), n)),
        F.transform("func_names", lambda n: F.concat(F.lit("  - fn "), n, F.lit("()"))),
    )
    body = F.when(F.size(items) > 0, F.array_join(items, "\n")).otherwise(F.lit(NO_SYMBOLS))
    heading = F.concat(F.lit("### 📄 `"), F.col("path"), F.lit("`\n"))
    return _named(symbols, keys).select(*keys, F.concat(heading, body).alias("section"))


def write_digest(symbols: DataFrame, title: str, out: str) -> None:
    """Write the digest as text files in path order, the metrics first.

    The sections are range-sorted by path and written by the executors; only the
    five counters pass through the driver.
    """
    stats = graph_stats(symbols).first()
    # The headings of the digest.
    head = [f"# Codebase Architecture Digest: {title}", "", "## High-Level Architecture Metrics"]
    head += [f"{label}{stats[key]}" for key, label in STAT_LABELS.items()]
    head += ["", "## Codebase Symbol Map", ""]
    spark = symbols.sparkSession
    top = spark.createDataFrame([("", "\n".join(head))], "path STRING, value STRING")
    sections = digest_rows(symbols).select("path", F.concat("section", F.lit("\n")).alias("value"))
    top.unionByName(sections).orderBy("path").select("value").write.mode("overwrite").text(out)


def node_json(nodes: DataFrame) -> DataFrame:
    payload = F.struct("id", "label", F.col("grp").alias("group"), "title", "path", "shape", "size")
    return nodes.select("id", F.to_json(payload).alias("json"))


def edge_json(edges: DataFrame) -> DataFrame:
    payload = F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "label")
    return edges.select(F.concat("src", F.lit("->"), "dst").alias("id"), F.to_json(payload).alias("json"))


def filter_nodes(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes whose label contains the query, in any case."""
    return nodes.filter(F.contains(F.lower("label"), F.lower(F.lit(query))))


def prune_stale(graph: DataFrame, current_files: DataFrame) -> DataFrame:
    """Nodes (or edges) of files that still exist; both ends of an edge share their file."""
    alive = current_files.select("repo", F.col("path").alias("file"))
    return sized_join(graph, alive, ["repo", "file"], "left_semi")


def importers_of(imports: DataFrame, module: str | None = None) -> DataFrame:
    """Files per imported name, for one name or for all of them.

    A name with very many importers is combined inside each task first.
    """
    wanted = imports if module is None else imports.filter(F.col("module") == module)
    return wanted.select("module", "repo", "path").distinct()
