"""Derived views: the same SQL text builds a code corpus, a commit history and a store
from the given tables in Spark and in a SQL database.

The texts keep to what both dialects read alike.  Every view covers its whole
source tables; ``CASE`` on the key only varies what is planted in a row.
Placeholders such as ``$documents`` name the source tables.
"""

from __future__ import annotations

from string import Template

from pyspark.sql import DataFrame, SparkSession

SOURCES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_NL = "chr(10)"
_Q = "chr(34)"
_Q3 = "chr(34) || chr(34) || chr(34)"
_I = "CAST(doc_id AS STRING)"
# The document's whole text as comment lines.
_AS_COMMENT = f"'# ' || replace(replace(text, chr(13), ' '), {_NL}, {_NL} || '# ')"


def _lines(*parts: str) -> str:
    return f" || {_NL} || ".join(parts)


PY_LINES = (
    f"{_Q3} || 'Module m' || {_I} || '.'",
    "''",
    f"'Handles part ' || {_I} || '.'",
    f"{_Q3}",
    "'import os'",
    "'import numpy as np'",
    "'from lib' || CAST(doc_id % 5 AS STRING) || ' import helper as h, other'",
    "'from . import sibling'",
    "'from pkg.sub import *'",
    f"'password = ' || {_Q} || 'hunter' || {_I} || 'hunter' || {_Q}",
    "'if True:'",
    "'    def hidden(): pass'",
    f"'class Base' || {_I} || ':'",
    f"'    ' || {_Q3} || ' Base of ' || {_I} || '. ' || {_Q3}",
    "'    def run(self, a, b=1, *args, c, **kw):'",
    f"'        ' || {_Q3} || 'Run it.' || {_Q3}",
    f"'        # TODO: run step ' || {_I}",
    "'        def inner(): pass'",
    "'        return a'",
    "'    class Nested: pass'",
    f"'class Child' || {_I} || '(Base' || {_I} || ', mod.Other):'",
    "'    async def go(self): pass  # note: later'",
    "'def top(p, /, q, *, r):'",
    f"'    s = ' || {_Q} || '# FIXME not a comment' || {_Q}",
    "'async def atop(x): pass  # TODOs do not count'",
    "'def top(z): pass'",
    # Source that never parses, and source that stops parsing once the secret is redacted.
    "CASE WHEN doc_id % 56 = 0 THEN 'def broken(:' "
    f"WHEN doc_id % 56 = 8 THEN 'call(a=1, token=' || {_Q} || 'longsecret' || {_Q} || ')' ELSE '' END",
    _AS_COMMENT,
)

TS_LINES = (
    "'import ' || chr(123) || ' useState, b ' || chr(125) || ' from ' || chr(39) || 'react' || chr(39) || ';'",
    f"'import Store' || {_I} || ' from ' || {_Q} || './store' || {_Q}",
    f"'import * as x from ' || {_Q} || 'skipped' || {_Q}",
    f"'export default class Store' || {_I} || ' extends Base' || CAST(doc_id % 3 AS STRING) || ' ' || chr(123)",
    "'  fetch() ' || chr(123) || chr(125)",
    "chr(125)",
    "'// subclass Decoy'",
    f"'export async function load' || {_I} || '(id, opts) ' || chr(123) || ' return null; // TODO: load ' || {_I} || ' ' || chr(125)",
    "'const render = (m: Map<string, number>,  title) => 1;'",
    "'const bare = x => x;'",
    f"'const url = ' || {_Q} || 'http://host/' || {_I} || {_Q} || '; // FIXME link'",
    "'/* NOTE first' || chr(10) || ' * HACK second' || chr(10) || ' * plain'",
    "text || ' */'",
)

GO_LINES = (
    "'package main'",
    f"'type Node' || {_I} || ' struct ' || chr(123) || chr(125)",
    "'type  Pair   struct ' || chr(123) || chr(125)",
    f"'func (n *Node' || {_I} || ') Walk(depth int, seen map[string]bool) ' || chr(123) || chr(125) || ' // BUG: slow'",
    "'func main() ' || chr(123) || chr(125)",
    "'func Map[T any](x T) ' || chr(123) || chr(125)",
    "'/*' || text || '*/'",
)

RUST_LINES = (
    f"'pub struct Row' || {_I} || ' ' || chr(123) || chr(125)",
    "'enum Kind ' || chr(123) || chr(125)",
    f"'pub trait Load' || CAST(doc_id % 9 AS STRING) || ' ' || chr(123) || chr(125)",
    f"'pub async fn load' || {_I} || '(path: &str, n: u32) ' || chr(123) || chr(125)",
    "'fn foo<T>(x: T) ' || chr(123) || chr(125)",
    "'fn plain( ) ' || chr(123) || chr(125) || ' // deprecated soon'",
    "'/* ADR-7 ' || text || '*/'",
)

CSS_LINES = (
    "'/* TODO theme ' || chr(10) || '   ** warning: contrast */'",
    "'.a ' || chr(123) || ' color: red ' || chr(125) || ' /* no tag */'",
    "'/* ' || text || ' */'",
)

MD_LINES = (
    f"'# Part ' || {_I}",
    "'TODO outside a comment does not count'",
    "'<!-- NOTE inside' || chr(10) || '  bug two lines' || chr(10) || 'no tag -->'",
    "text",
)

SH_LINES = (
    "'#!/bin/sh'",
    f"'run ' || {_I} || ' # hack: retry'",
    f"'x=1 # ' || {_Q} || 'quoted' || {_Q} || ' ## Note both'",
    f"{_Q3} || '  kept text  ' || {_Q3} || ' ' || chr(39) || chr(39) || chr(39) || 'single' || chr(39) || chr(39) || chr(39)",
    _AS_COMMENT,
)

JS_LINES = (
    f"'class Plain' || {_I} || ' ' || chr(123) || chr(125)",
    "'function go(a, , b) ' || chr(123) || chr(125)",
    "'let later = async (x) => x'",
    "'// ' || replace(text, chr(10), chr(10) || '// ')",
)

_KINDS = (
    ("py", PY_LINES), ("ts", TS_LINES), ("go", GO_LINES), ("rs", RUST_LINES),
    ("css", CSS_LINES), ("md", MD_LINES), ("sh", SH_LINES), ("js", JS_LINES),
)

_EXT = "CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN '{ext}'" for k, (ext, _) in enumerate(_KINDS)) + " END"
_CONTENT = (
    "CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN {_lines(*rows)}" for k, (_, rows) in enumerate(_KINDS)) + " END"
)

# repo, path, ext, content, doc_id
CODE_FILES = f"""
SELECT source AS repo,
       'src/' || {_EXT} || '/f' || {_I} || '.' || {_EXT} AS path,
       '.' || {_EXT} AS ext,
       {_CONTENT} AS content,
       doc_id
FROM $documents
"""

_D = "CAST(doc_id AS STRING)"
_B = "CAST(block AS STRING)"
# What a file of the packages imports: the hub, the file before it (the last one closes a circle of
# sixteen), and now and then a file three places back.
PACKAGE_LINES = (
    "'import os'",
    "CASE WHEN i = 0 THEN '' ELSE 'from lib import core' END",
    f"CASE WHEN i = 0 THEN '' WHEN pos = 0 THEN 'from lib.p' || {_B} || '.m' || CAST(doc_id + 120 AS STRING) || ' import run, other' "
    f"WHEN pos = 1 THEN 'import p' || {_B} ELSE 'from p' || {_B} || ' import m' || CAST(doc_id - 8 AS STRING) || ' as prev' END",
    f"CASE WHEN pos > 3 AND pos % 4 = 3 THEN 'import lib.p' || {_B} || '.m' || CAST(doc_id - 24 AS STRING) ELSE '' END",
    "'def run(): pass'",
    _AS_COMMENT,
)

# repo, path, content, doc_id, i, block, pos: eight repositories of packages with sixteen files each
PACKAGE_FILES = f"""
SELECT repo,
       CASE WHEN i = 0 THEN 'lib/core.py' WHEN pos = 0 THEN 'lib/p' || {_B} || '/__init__.py'
            ELSE 'lib/p' || {_B} || '/m' || {_D} || '.py' END AS path,
       {_lines(*PACKAGE_LINES)} AS content,
       doc_id, i, block, pos
FROM (SELECT doc_id, text, 'mono' || CAST(doc_id % 8 AS STRING) AS repo,
             CAST(floor(doc_id / 8) AS BIGINT) AS i, CAST(floor(doc_id / 128) AS BIGINT) AS block,
             CAST(floor(doc_id / 8) AS BIGINT) % 16 AS pos
      FROM $documents) d
"""

# page_id, path: page addresses as paths, with folder and file names planted
PATHS = """
SELECT page_id,
       CASE page_id % 9 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'src/build/' WHEN 2 THEN 'Build/'
                        WHEN 3 THEN 'logs/' WHEN 4 THEN 'logs/keep/' WHEN 5 THEN 'deep/tmp/' ELSE '' END
       || replace(replace(translate(url, '?#&=', '----'), 'https://', ''), 'http://', '')
       || 'p' || CAST(page_id AS STRING)
       || CASE page_id % 12 WHEN 0 THEN '.py' WHEN 1 THEN '.PY' WHEN 2 THEN '.md' WHEN 3 THEN '.tsx'
                            WHEN 4 THEN '.json' WHEN 5 THEN '/Dockerfile' WHEN 6 THEN '/dockerfile'
                            WHEN 7 THEN '/.gitignore' WHEN 8 THEN '/.env' WHEN 9 THEN '/.env.example'
                            WHEN 10 THEN '/build' ELSE '.log' END AS path
FROM $pages
"""

# repo, path, folder: one project folder per address
FOLDERS = """
SELECT page_id,
       '/srv/' || replace(replace(url, 'https://', ''), 'http://', '')
       || CASE page_id % 3 WHEN 0 THEN '/My-Repo ' WHEN 1 THEN '/web-app/' ELSE '/Core' END AS folder
FROM $pages
"""

_ORDER_HASH = "md5(CAST(o_orderkey AS STRING))"

# repo, hash, author, email, authored_ts, tz, message, is_root
COMMITS = f"""
SELECT 'repo' || CAST(o_custkey % 50 AS STRING) AS repo,
       {_ORDER_HASH} AS hash,
       'Dev ' || CAST(o_custkey AS STRING) AS author,
       'dev' || CAST(o_custkey AS STRING) || '@example.com' AS email,
       o_orderdate AS authored_ts,
       CASE o_orderkey % 3 WHEN 0 THEN '+00:00' WHEN 1 THEN '+05:30' ELSE '-08:00' END AS tz,
       '  ' || o_orderpriority || {_NL} || {_NL} || 'State ' || o_orderstatus || {_NL} AS message,
       o_orderkey % 97 = 0 AS is_root
FROM $orders
"""

# hash, ord, a_path, b_path, patch, is_root.  ``ord`` is a dense number per commit in part
# order.  It is built in two steps, counts per range of parts and numbers within a range,
# so that a commit with very many lines is never sorted as one group.
COMMIT_FILES = """
WITH lines AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag, l_linestatus,
         l_partkey - l_partkey % 100 AS span
  FROM $lineitem
), counts AS (
  SELECT l_orderkey, span, count(*) AS n FROM lines GROUP BY l_orderkey, span
), offsets AS (
  SELECT l_orderkey, span,
         sum(n) OVER (PARTITION BY l_orderkey ORDER BY span
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS before
  FROM counts
), numbered AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag, span,
         row_number() OVER (PARTITION BY l_orderkey, span
                            ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag) AS rn
  FROM lines
)
SELECT md5(CAST(a.l_orderkey AS STRING)) AS hash,
       CAST(b.before + a.rn - 1 AS BIGINT) AS ord,
       'src/p' || CAST(a.l_partkey AS STRING) || '.py' AS a_path,
       CASE WHEN a.l_returnflag = 'R' THEN ''
            ELSE 'src/s' || CAST(a.l_suppkey AS STRING) || '/p' || CAST(a.l_partkey AS STRING) || '.py' END AS b_path,
       CASE WHEN a.l_linenumber = 7 THEN NULL
            ELSE repeat(chr(96 + CAST(a.l_linenumber AS INT)), CAST(a.l_quantity AS INT) * 30) END AS patch,
       a.l_orderkey % 97 = 0 AS is_root
FROM numbered a JOIN offsets b ON a.l_orderkey = b.l_orderkey AND a.span = b.span
"""

# repo, a_path, b_path, area: users as repositories, events as changed paths
STATUS = """
SELECT 'repo' || CAST(user_id AS STRING) AS repo,
       'src' || chr(92) || 'old' || CAST(event_id % 40 AS STRING) || '.py' AS a_path,
       CASE WHEN event_type = 'error' THEN ''
            ELSE 'src' || chr(92) || 'm' || CAST(event_id % 25 AS STRING) || '.py' END AS b_path,
       CASE WHEN user_id % 3 = 0 THEN 'last_commit'
            WHEN event_type = 'click' THEN 'unstaged'
            WHEN event_type = 'view' THEN 'staged'
            WHEN event_type = 'signup' THEN 'untracked'
            ELSE 'last_commit' END AS area
FROM $events
"""

# Two scans of one tree: files moved, changed and left alone between them.
SNAP_OLD = f"""
SELECT source AS repo, 'docs/' || {_I} || '.md' AS path, text AS content FROM $documents
"""
SNAP_NEW = f"""
SELECT source AS repo,
       CASE WHEN doc_id % 17 = 0 THEN 'moved/' ELSE 'docs/' END || {_I} || '.md' AS path,
       CASE WHEN doc_id % 10 = 0 THEN text || ' edited' ELSE text END AS content
FROM $documents
"""

# dataset, doc_id, kind, path, text (before redaction)
MEMORY_DOCS = f"""
SELECT 'codemem_' || source AS dataset,
       {_I} AS doc_id,
       'file' AS kind,
       'docs/' || lang || '/' || {_I} || '.md' AS path,
       'File Path: docs/' || lang || '/' || {_I} || '.md' || {_NL}
       || '[AST CODE SYMBOLS] File: docs/' || lang || '/' || {_I} || '.md' || {_NL} || '---' || {_NL}
       || text AS text,
       doc_id AS doc_no
FROM $documents
"""

# id, ts, text
DECISIONS = """
SELECT event_id AS id, ts,
       CASE WHEN event_id % 31 = 0 THEN '' ELSE 'Use ' || event_type || ' settings ' || props END AS text
FROM $events
"""

VIEWS = {
    "code_files": CODE_FILES,
    "package_files": PACKAGE_FILES,
    "paths": PATHS,
    "folders": FOLDERS,
    "commits": COMMITS,
    "commit_files": COMMIT_FILES,
    "status": STATUS,
    "snap_old": SNAP_OLD,
    "snap_new": SNAP_NEW,
    "memory_docs": MEMORY_DOCS,
    "decisions": DECISIONS,
}


def view_sql(name: str, prefix: str = "") -> str:
    """SQL text of a view over source tables whose names start with ``prefix``."""
    return Template(VIEWS[name]).substitute({t: prefix + t for t in SOURCES}).strip()


# Tables whose rows are worth much CPU time each.
LONG_TEXTS = ("documents", "pages")


def _spread(scan: DataFrame) -> DataFrame:
    """Give every core a share of a scan that comes in fewer splits than there are cores.

    Large inputs have more splits than cores and are left as they are.  On a plain
    file scan, asking for the number of splits plans but runs nothing.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


class Tables:
    """Source tables of a folder and the views derived from them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def source(self, name: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return _spread(rows) if name in LONG_TEXTS else rows

    def __getattr__(self, name: str) -> DataFrame:
        if name in SOURCES:
            return self.source(name)
        if name not in VIEWS:
            raise AttributeError(name)
        text = VIEWS[name]
        for table in SOURCES:
            if f"${table}" in text:
                self.source(table).createOrReplaceTempView(f"codemem_{table}")
        return self.spark.sql(view_sql(name, "codemem_"))
