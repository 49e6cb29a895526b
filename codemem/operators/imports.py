"""Imports as a graph of files: module names to files, who imports what at any distance, neighbours.

A file answers to every suffix of its path (``lib/tax/rate.py`` to ``rate``, ``tax/rate`` and
``lib/tax/rate``); a package's ``__init__`` and a folder's ``index`` answer to the folder too.  An
import is looked up by its whole name and then without the last part, which may be a name inside the
module.  So all matching is by equal keys, and a name that everybody imports is one more hot key that
the adaptive planner splits.

Walks over the graph go level by level: one join of the newest rows, and only those, with the edges,
until no row is new.  Every level is a written table, so a lost executor repeats one level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codemem.operators.joins import sized_join
from codemem.session import work_dir

PYTHON = ("py",)
SCRIPTS = ("js", "jsx", "ts", "tsx")
# Files that stand for their folder.
FOLDER_FILES = ("__init__", "index")


def _family(path: Column) -> Column:
    """Files of a family import each other."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    return F.when(ending.isin(*PYTHON), "python").when(ending.isin(*SCRIPTS), "script")


def _suffixes(parts: Column) -> Column:
    """``[a, b, c]`` to ``c``, ``b/c``, ``a/b/c`` and ``/a/b/c``, the name that only the whole path has."""
    some = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "/"))
    return F.when(F.size(parts) > 0, F.concat(some, F.array(F.concat(F.lit("/"), F.array_join(parts, "/")))))


def module_names(files: DataFrame) -> DataFrame:
    """``repo, family, name, target``: the file that a name stands for, the one nearest to the root."""
    parts = F.split(F.regexp_replace("path", r"\.[A-Za-z]+$", ""), "/")
    named = files.select("repo", "path", _family(F.col("path")).alias("family"), parts.alias("parts")).filter(F.col("family").isNotNull())
    inner = F.slice("parts", 1, F.size("parts") - 1)
    of_folder = F.when(F.element_at("parts", -1).isin(*FOLDER_FILES), _suffixes(inner))
    names = F.concat(_suffixes(F.col("parts")), F.coalesce(of_folder, F.array().cast("array<string>")))
    # The depth goes first in the comparison: the nearest file, then the smallest path.
    rows = named.select("repo", "family", F.explode(names).alias("name"), F.struct(F.size("parts").alias("depth"), "path").alias("file"))
    return rows.groupBy("repo", "family", "name").agg(F.min("file").alias("file")).select("repo", "family", "name", F.col("file.path").alias("target"))


def _whole_name(module: Column, path: Column, family: Column) -> Column:
    """The path-like name of an import; a script's relative one is taken from its own folder."""
    folder = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    step = lambda at, part: (
        F.when(part == "..", F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0)))).when(part.isin("", "."), at).otherwise(F.concat(at, F.array(part)))
    )
    beside = F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(module, "/"), folder, step), "/"))
    plain = F.regexp_replace(module, r"\.(jsx?|tsx?)$", "")
    return F.when(family == "python", F.replace(module, F.lit("."), F.lit("/"))).when(F.startswith(module, F.lit(".")), F.regexp_replace(beside, r"\.(jsx?|tsx?)$", "")).otherwise(plain)


def import_edges(files: DataFrame, imports: DataFrame) -> DataFrame:
    """``repo, path, module, target, inside``: the file of the same repository that an import names.

    ``files(repo, path)`` is the scan, ``imports(repo, path, module)`` its imports.  What no file
    answers to is outside: its target is the module's own name.
    """
    family = _family(F.col("path"))
    asked = imports.select("repo", "path", "module").distinct().withColumn("family", family)
    asked = asked.withColumn("name", _whole_name(F.col("module"), F.col("path"), family))
    asked = asked.withColumn("shorter", F.when(F.contains("name", F.lit("/")), F.regexp_replace("name", "/[^/]*$", "")))
    names = module_names(files)
    for column in ("name", "shorter"):
        known = names.select("repo", "family", F.col("name").alias(column), F.col("target").alias(f"by_{column}"))
        asked = sized_join(asked, known, ["repo", "family", column], "left")
    target = F.coalesce("by_name", "by_shorter")
    return asked.select("repo", "path", "module", F.coalesce(target, "module").alias("target"), target.isNotNull().alias("inside"))


# ---- walks ----------------------------------------------------------------------------


def _levels(first: DataFrame, step, at: str, most: int | None) -> DataFrame:
    """Writes ``first`` and then ``step(newest rows, all rows)`` until a level is empty; all levels."""
    spark = first.sparkSession
    level, rows = 1, first
    while True:
        rows.write.parquet(f"{at}/hops={level}")
        newest = spark.read.parquet(f"{at}/hops={level}")
        if newest.isEmpty() or level == most:
            return spark.read.parquet(at).withColumn("hops", F.col("hops").cast("bigint"))
        rows = step(newest, spark.read.parquet(at).drop("hops"))
        level += 1


def importers_closure(edges: DataFrame, targets: DataFrame | None = None, most_hops: int | None = None) -> DataFrame:
    """``repo, target, path, hops``: files that import a target, themselves or through other files.

    ``targets(repo, target)`` names files or outside modules; all by default.  ``hops`` is the length
    of the shortest chain.  Cycles end because only pairs that are new go on; a file is not its own importer.
    """
    links = edges.select("repo", "target", "path").filter("target <> path").distinct()
    at = work_dir(edges.sparkSession, "importers")
    links.write.parquet(f"{at}/links")
    links = edges.sparkSession.read.parquet(f"{at}/links")
    next_ = links.select("repo", F.col("target").alias("through"), F.col("path").alias("importer"))

    def step(newest: DataFrame, known: DataFrame) -> DataFrame:
        reached = sized_join(newest.withColumnRenamed("path", "through"), next_, ["repo", "through"], "inner")
        reached = reached.select("repo", "target", F.col("importer").alias("path")).filter("target <> path").distinct()
        return sized_join(reached, known, ["repo", "target", "path"], "left_anti")

    first = links if targets is None else sized_join(links, targets.select("repo", "target").distinct(), ["repo", "target"], "left_semi")
    return _levels(first, step, f"{at}/levels", most_hops)


def import_neighbours(seeds: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """``rank, repo, file, hops, via``: files within some imports of a result's file, in either direction.

    ``seeds(rank, repo, path)``.  ``via`` lists the files of the shortest way, the seed first; of
    several ways the smallest.
    """
    inside = edges.filter("inside and target <> path")
    both = inside.select("repo", F.col("path").alias("file"), F.col("target").alias("near"))
    both = both.unionByName(inside.select("repo", F.col("target").alias("file"), F.col("path").alias("near"))).distinct()
    at = work_dir(seeds.sparkSession, "neighbours")
    both.write.parquet(f"{at}/links")
    both = seeds.sparkSession.read.parquet(f"{at}/links")
    start = seeds.select("rank", "repo", F.col("path").alias("file")).distinct()
    start = start.withColumn("via", F.array("file"))
    start.write.parquet(f"{at}/seeds")
    start = seeds.sparkSession.read.parquet(f"{at}/seeds")

    def step(newest: DataFrame, known: DataFrame) -> DataFrame:
        reached = sized_join(newest, both, ["repo", "file"], "inner")
        reached = reached.groupBy("rank", "repo", F.col("near").alias("file")).agg(F.min(F.concat("via", F.array("near"))).alias("via"))
        seen = known.select("rank", "repo", "file").unionByName(start.select("rank", "repo", "file"))
        return sized_join(reached, seen, ["rank", "repo", "file"], "left_anti")

    return _levels(step(start, start), step, f"{at}/levels", hops).select("rank", "repo", "file", "hops", "via")
