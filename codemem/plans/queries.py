"""Registered queries: every operator over the given tables and the views derived from them."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from codemem.functions import tables, text as tx, vectors as vx
from codemem.operators import (
    comments as cm,
    commits as ci,
    files as fi,
    graph as gr,
    imports as im,
    memory as mem,
    nearest as ne,
    snapshots as sn,
    symbols as sy,
)
from codemem.plans import remember as rm
from codemem.plans.graph_store import GraphStore
from codemem.plans.store import MemoryStore
from codemem.plans.vector_index import VectorIndex
from codemem.plans.views import Tables
from codemem.session import mounted, work_dir, written
from codemem.sources import ignore, tree
from codemem.streaming import decisions as sd

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Rules the ignore query applies to the derived paths.
IGNORE_LINES = (
    "# logs",
    "*.log",
    "!*7.log",
    "node_modules/",
    "/logs/*",
    "!/logs/keep/",
    "deep/**/Dockerfile",
    "src/build",
    "*.[tj]sx",
    "/www.*/en/**",
)
# Rule files of three repositories: the same names, with contrary rules; the fourth has none.
RULE_FILES = {
    "repo0": "\n".join(IGNORE_LINES),
    "repo1": "*\n!*/\n!*.log\n!*.py\nnode_modules\n",
    "repo2": "!*.log\n*.md\nlogs/\n!logs/keep/\n",
}
GRAPH_FILTER = "BASE1"
RECALL_DATASET = "codemem_src0"
FORGET_DATASETS = ("codemem_src1", "codemem_unknown")
FORGET_PATH = "docs/en/1"
FORGET_TAGS = ("en",)
TIMELINE_ROWS = 20


def register(query: Query) -> Query:
    REGISTRY[query.__name__] = query
    return query


# ---- shared inputs --------------------------------------------------------------------


def _code(spark: SparkSession, sf: str) -> DataFrame:
    return Tables(spark, sf).code_files


def _of(spark: SparkSession, sf: str, *exts: str) -> DataFrame:
    return _code(spark, sf).filter(F.col("ext").isin(*exts))


def _symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols of the scanned (redacted) corpus."""
    return sy.extract_symbols(rm.scanned_files(_code(spark, sf)).select("repo", "path", "content"))


def _py(spark: SparkSession, sf: str) -> DataFrame:
    return sy.python_symbols(_of(spark, sf, ".py").select("path", "content"))


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return Tables(spark, sf).memory_docs


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return mem.ingest(_docs(spark, sf).drop("doc_no"))


def _query_text(spark: SparkSession, sf: str) -> str:
    """The recall question: the text of the first benchmark item."""
    return Tables(spark, sf).benchmark.agg(F.min_by("text", "item_id")).first()[0]


def _question(spark: SparkSession, sf: str) -> list[float]:
    return mem.query_vector(spark, _query_text(spark, sf))


def _joined(array) -> F.Column:
    return F.array_join(array, ", ")


# ---- sources and path filters ---------------------------------------------------------


def _export_tree(files: DataFrame, root: str) -> None:
    """Write ``files(repo, path, content)`` as a tree; executors write, rows stay where they are."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for row in batch.to_pylist():
                at = os.path.join(root, row["repo"], row["path"])
                os.makedirs(os.path.dirname(at), exist_ok=True)
                with open(at, "w", encoding="utf-8", newline="") as handle:
                    handle.write(row["content"])
                n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    files.select("repo", "path", "content").mapInArrow(write, "n BIGINT").agg(F.sum("n")).collect()


@register
def scan_corpus(spark: SparkSession, sf: str) -> DataFrame:
    root = mounted(work_dir(spark, "tree"))
    _export_tree(_code(spark, sf), root)
    found = tree.read_tree(spark, root, repo="corpus").filter(F.col("error").isNull())
    kept = fi.substantial_files(found).select("relative_path", tx.redact(F.col("content")).alias("content"))
    return kept.select(
        F.col("relative_path").alias("path"),
        F.length("content").cast("bigint").alias("n_chars"),
        F.sha2("content", 256).alias("sha256"),
    )


@register
def filter_ignored_dirs(spark: SparkSession, sf: str) -> DataFrame:
    return fi.outside_ignored_dirs(Tables(spark, sf).paths)


@register
def filter_text_files(spark: SparkSession, sf: str) -> DataFrame:
    return fi.text_files(Tables(spark, sf).paths)


@register
def filter_gitignore(spark: SparkSession, sf: str) -> DataFrame:
    return fi.not_ignored(Tables(spark, sf).paths, ignore.compile_rules(IGNORE_LINES))


@register
def filter_gitignore_by_repo(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of four repositories, each under its own rules."""
    paths = Tables(spark, sf).paths.select("page_id", F.concat(F.lit("repo"), (F.col("page_id") % 4).cast("string")).alias("repo"), "path")
    scans = spark.createDataFrame([(r, ".gitignore", text) for r, text in RULE_FILES.items()], "repo STRING, path STRING, content STRING")
    return fi.not_ignored_by_rules(paths, ignore.rule_rows(scans)).select("page_id", "repo", "path")


@register
def decode_text(spark: SparkSession, sf: str) -> DataFrame:
    crlf = F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n"))
    # Every odd document gets a stray byte and a cut-off sequence before its last word.
    stray = F.when(F.col("doc_id") % 2 == 1, F.unhex(F.lit("FFC3"))).otherwise(F.unhex(F.lit("")))
    raw = F.concat(F.encode(crlf, "UTF-8"), stray, F.encode(F.lit("é\rend"), "UTF-8"))
    files = Tables(spark, sf).documents.select("doc_id", raw.alias("raw"))
    return fi.decode_utf8(files)


@register
def filter_trivial(spark: SparkSession, sf: str) -> DataFrame:
    kept = fi.substantial_files(Tables(spark, sf).documents, "text")
    return kept.select("doc_id", F.length("text").cast("bigint").alias("n_chars"))


@register
def redact_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return Tables(spark, sf).documents.select("doc_id", tx.redact(F.col("text")).alias("text"))


@register
def redact_report(spark: SparkSession, sf: str) -> DataFrame:
    texts = Tables(spark, sf).documents.select("text").unionByName(_code(spark, sf).select(F.col("content").alias("text")))
    hits = tx.secret_hits(F.col("text"))
    per_text = texts.select(F.array(*[F.struct(F.lit(k).alias("pattern"), v.alias("n")) for k, v in hits.items()]).alias("h"))
    rows = sy.rows_of(per_text, "h", "h1").select("h1.*")
    return rows.groupBy("pattern").agg(
        F.sum("n").cast("bigint").alias("hits"), F.count_if(F.col("n") > 0).cast("bigint").alias("texts")
    )


@register
def dataset_names(spark: SparkSession, sf: str) -> DataFrame:
    return Tables(spark, sf).folders.select("page_id", fi.dataset_name(F.col("folder")).alias("dataset"))


@register
def tagged_docs(spark: SparkSession, sf: str) -> DataFrame:
    docs = rm.file_documents(_code(spark, sf), F.col("repo"))
    return docs.select("path", "text")


@register
def changed_files(spark: SparkSession, sf: str) -> DataFrame:
    return fi.changed_files(Tables(spark, sf).status)


def _changes(t: Tables) -> DataFrame:
    diff = sn.snapshot_diff(t.snap_old, t.snap_new)
    return diff.filter(F.col("change_type").isin("added", "modified"))


@register
def incremental_files(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    chosen = fi.incremental_files(t.snap_new, _changes(t))
    return chosen.select("repo", "path", F.length("content").cast("bigint").alias("n_chars"))


# ---- symbols --------------------------------------------------------------------------


@register
def symbols_all(spark: SparkSession, sf: str) -> DataFrame:
    size = lambda c: F.size(c).cast("bigint")
    return _symbols(spark, sf).select(
        "repo", "path", size("imports").alias("n_imports"), size("classes").alias("n_classes"),
        size("functions").alias("n_functions"), F.col("parse_ok").cast("bigint").alias("parse_ok"),
    )


@register
def py_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Classes and functions of Python files, module docstring alongside."""
    found = _py(spark, sf)
    about = F.struct("path", "module_docstring")
    classes = sy.class_rows(found.withColumn("of", about), ("of",)).withColumn("kind", F.lit("class"))
    functions = sy.function_rows(found.withColumn("of", about), ("of",)).withColumn("kind", F.lit("function"))
    cols = lambda args: [
        F.col("of.path").alias("path"), F.col("of.module_docstring").alias("module_docstring"), "kind",
        F.col("pos").cast("bigint").alias("pos"), "name", args.alias("args"), "docstring",
        F.col("lineno").cast("bigint").alias("lineno"),
    ]
    return classes.select(*cols(F.lit(""))).unionByName(functions.select(*cols(_joined("args"))))


@register
def py_symbols_sql(spark: SparkSession, sf: str) -> DataFrame:
    """The same by a table function in SQL."""
    tables.register(spark)
    _of(spark, sf, ".py").createOrReplaceTempView("codemem_python_files")
    return spark.sql(
        "SELECT f.path, s.module_docstring, s.kind, s.pos, s.name, s.args, s.docstring, s.lineno "
        "FROM codemem_python_files f, LATERAL python_symbols(f.content) s WHERE s.kind IN ('class', 'function')"
    )


@register
def py_bases(spark: SparkSession, sf: str) -> DataFrame:
    return sy.base_rows(_py(spark, sf))


@register
def py_methods(spark: SparkSession, sf: str) -> DataFrame:
    rows = sy.method_rows(_py(spark, sf))
    return rows.select(
        "path", "class", "name", _joined("args").alias("args"), "docstring", F.col("lineno").cast("bigint").alias("lineno")
    )


@register
def py_imports(spark: SparkSession, sf: str) -> DataFrame:
    return sy.import_rows(_py(spark, sf)).select("path", F.col("pos").cast("bigint").alias("pos"), "module")


@register
def parse_failures(spark: SparkSession, sf: str) -> DataFrame:
    return _symbols(spark, sf).filter(~F.col("parse_ok")).select("repo", "path")


def _regex_classes(spark: SparkSession, sf: str, exts: tuple[str, ...], extract) -> DataFrame:
    found = _of(spark, sf, *exts).select("path", extract(F.col("content")).alias("c"))
    rows = sy.rows_of(found, "c", "r", "pos")
    base = F.get(F.col("r.bases"), F.lit(0))
    return rows.select("path", F.col("pos").cast("bigint").alias("pos"), F.col("r.name").alias("name"), base.alias("base"))


def _regex_functions(spark: SparkSession, sf: str, exts: tuple[str, ...], extract) -> DataFrame:
    found = _of(spark, sf, *exts).select("path", extract(F.col("content")).alias("f"))
    rows = sy.rows_of(found, "f", "r", "pos")
    return rows.select(
        "path", F.col("pos").cast("bigint").alias("pos"), F.col("r.name").alias("name"), _joined("r.args").alias("args")
    )


@register
def js_classes(spark: SparkSession, sf: str) -> DataFrame:
    return _regex_classes(spark, sf, sy.JS_SUFFIXES, sy.js_classes)


@register
def js_functions(spark: SparkSession, sf: str) -> DataFrame:
    return _regex_functions(spark, sf, sy.JS_SUFFIXES, sy.js_functions)


@register
def js_arrows(spark: SparkSession, sf: str) -> DataFrame:
    return _regex_functions(spark, sf, sy.JS_SUFFIXES, sy.js_arrows)


@register
def js_imports(spark: SparkSession, sf: str) -> DataFrame:
    found = _of(spark, sf, *sy.JS_SUFFIXES).select("path", sy.js_imports(F.col("content")).alias("i"))
    return sy.rows_of(found, "i", "module", "pos").select("path", F.col("pos").cast("bigint").alias("pos"), "module")


@register
def go_structs(spark: SparkSession, sf: str) -> DataFrame:
    return _regex_classes(spark, sf, (sy.GO_SUFFIX,), sy.go_structs).drop("base")


@register
def go_functions(spark: SparkSession, sf: str) -> DataFrame:
    return _regex_functions(spark, sf, (sy.GO_SUFFIX,), sy.go_functions)


@register
def rust_types(spark: SparkSession, sf: str) -> DataFrame:
    return _regex_classes(spark, sf, (sy.RUST_SUFFIX,), sy.rust_types).drop("base")


@register
def rust_functions(spark: SparkSession, sf: str) -> DataFrame:
    return _regex_functions(spark, sf, (sy.RUST_SUFFIX,), sy.rust_functions)


@register
def symbol_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _symbols(spark, sf).select("repo", "path", sy.summary_text(F.col("path"), sy.MAX_SUMMARY_IMPORTS).alias("summary"))


# ---- comments -------------------------------------------------------------------------


def _comment_rows(files: DataFrame, records, key: str = "path") -> DataFrame:
    rows = sy.rows_of(files.select(key, records.alias("records")), "records", "r").select(key, "r.*")
    big = lambda c: F.col(c).cast("bigint").alias(c)
    return rows.select(key, big("line"), big("ord"), "text")


@register
def tag_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Every tag of every record."""
    tags = F.regexp_extract_all("text", F.lit(cm.tag_pattern().replace("(?:", "(", 1)), F.lit(1))
    tagged = cm.comments(_code(spark, sf)).select(F.explode(tags).alias("tag")).select(F.upper("tag").alias("tag"))
    return tagged.groupBy("tag").agg(F.count("*").alias("n"))


@register
def comments_hash(spark: SparkSession, sf: str) -> DataFrame:
    return _comment_rows(_of(spark, sf, *cm.HASH_SUFFIXES), cm.hash_comments(F.col("content"))).drop("ord")


@register
def comments_docstring(spark: SparkSession, sf: str) -> DataFrame:
    return _comment_rows(_of(spark, sf, *cm.HASH_SUFFIXES), cm.docstring_comments(F.col("content"))).drop("line")


@register
def comments_slash(spark: SparkSession, sf: str) -> DataFrame:
    return _comment_rows(_of(spark, sf, *cm.SLASH_SUFFIXES), cm.slash_comments(F.col("content"))).drop("ord")


@register
def comments_block(spark: SparkSession, sf: str) -> DataFrame:
    return _comment_rows(_of(spark, sf, *cm.SLASH_SUFFIXES), cm.block_comments(F.col("content"))).drop("line")


@register
def comments_html(spark: SparkSession, sf: str) -> DataFrame:
    """On the raw pages, whose comments carry the word ``ad``."""
    return _comment_rows(Tables(spark, sf).pages, cm.html_comments(F.col("html"), ("AD",)), "page_id").drop("line")


@register
def comments_all(spark: SparkSession, sf: str) -> DataFrame:
    rows = cm.comments(_code(spark, sf))
    return rows.select("path", "kind", F.col("ord").cast("bigint").alias("ord"), "text")


@register
def comment_log(spark: SparkSession, sf: str) -> DataFrame:
    return cm.comment_logs(_code(spark, sf))


# ---- commits --------------------------------------------------------------------------


@register
def commits_latest(spark: SparkSession, sf: str) -> DataFrame:
    newest = ci.latest_commits(Tables(spark, sf).commits)
    return newest.select("repo", "hash", F.col("rank").cast("bigint").alias("rank"))


@register
def commit_headers(spark: SparkSession, sf: str) -> DataFrame:
    return ci.commit_headers(Tables(spark, sf).commits)


@register
def commit_diffs(spark: SparkSession, sf: str) -> DataFrame:
    return ci.commit_diffs(Tables(spark, sf).commit_files, ci.PATCH_CHARS)


@register
def patch_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return Tables(spark, sf).commit_files.select("hash", "ord", ci.truncated(F.col("patch"), ci.PATCH_CHARS).alias("patch"))


@register
def commit_root_files(spark: SparkSession, sf: str) -> DataFrame:
    return ci.commit_root_files(Tables(spark, sf).commit_files)


@register
def commit_docs(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    return ci.commit_docs(t.commits, t.commit_files, ci.PATCH_CHARS)


# ---- memory ---------------------------------------------------------------------------


@register
def ingest_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks as stored, with the mass of their vectors."""
    mass = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return _chunks(spark, sf).select(
        "dataset", "doc_id", "chunk_no", F.sha2("text", 256).alias("sha256"), F.round(mass, 4).alias("mass")
    )


@register
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    return mem.chunk_documents(Tables(spark, sf).documents.select("doc_id", "text"))


@register
def embed_hash(spark: SparkSession, sf: str) -> DataFrame:
    docs = Tables(spark, sf).documents.select("doc_id", vx.hash_embedding(F.col("text")).alias("embedding"))
    sparse = docs.select("doc_id", vx.nonzero(F.col("embedding")).alias("entries"))
    rows = sy.rows_of(sparse, "entries", "e")
    return rows.select("doc_id", F.col("e.bucket").alias("bucket"), F.round(F.col("e.weight").cast("double"), 6).alias("weight"))


@register
def index_write(spark: SparkSession, sf: str) -> DataFrame:
    store = MemoryStore(spark, work_dir(spark, "store")).create()
    store.ingest(_docs(spark, sf))
    docs = store.docs().groupBy("dataset").agg(F.count("*").alias("n_docs"))
    chunks = store.chunks().groupBy("dataset").agg(
        F.count("*").alias("n_chunks"), F.sum(F.length("text")).cast("bigint").alias("n_chars")
    )
    return docs.join(chunks, "dataset", "left")


_RESULT = ("rank", "dataset", "doc_id", "chunk_no", "score", "text")


@register
def recall_topk(spark: SparkSession, sf: str) -> DataFrame:
    chunks = _chunks(spark, sf)
    return mem.recall(chunks, _question(spark, sf), datasets=[RECALL_DATASET]).select(*_RESULT)


@register
def recall_all_datasets(spark: SparkSession, sf: str) -> DataFrame:
    return mem.recall(_chunks(spark, sf), _question(spark, sf), k=10).select(*_RESULT)


@register
def recall_per_dataset(spark: SparkSession, sf: str) -> DataFrame:
    return mem.recall_per_dataset(_chunks(spark, sf), _question(spark, sf)).select(*_RESULT)


@register
def recall_answer_text(spark: SparkSession, sf: str) -> DataFrame:
    results = mem.recall(_chunks(spark, sf), _question(spark, sf), k=10)
    return mem.answer_text(results.select("rank", "text"))


@register
def recall_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark text as a question to the whole memory."""
    asked = Tables(spark, sf).benchmark.select(F.col("item_id").alias("query_id"), "text")
    queries = mem.hash_embedder()(asked)
    return mem.recall_batch(_chunks(spark, sf), queries)


@register
def recall_similar(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest chunk of every chunk of each hundredth document; equal vectors share all buckets."""
    chunks = written(_chunks(spark, sf).select(*mem.CHUNK_KEY, "embedding"), "chunks")
    asked = chunks.filter(F.col("doc_id").cast("bigint") % 100 == 0)
    asked = asked.select(F.concat_ws(":", "doc_id", "chunk_no").alias("query_id"), "embedding")
    return ne.recall_similar(chunks, asked, k=1)


@register
def recall_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth benchmark text asked of an index of all chunks; equal to a scan of everything."""
    index = VectorIndex(spark, work_dir(spark, "index")).build(_chunks(spark, sf))
    asked = Tables(spark, sf).benchmark.filter(F.col("item_id") % 10 == 0).select(F.col("item_id").alias("query_id"), "text")
    found = index.recall_batch(mem.hash_embedder()(asked), k=10)
    return found.select("query_id", *_RESULT)


@register
def recall_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of an outside model: the mean vector of each label as question."""
    stored = Tables(spark, sf).embeddings
    entries = stored.select("label", F.posexplode("embedding").alias("i", "x"))
    means = entries.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"])
    queries = means.groupBy(F.col("label").alias("query_id")).agg(ordered.alias("embedding"))
    return mem.recall_batch(stored.select("vec_id", "embedding"), queries, k=5, key=("vec_id",), unit_vectors=False)


@register
def dedup_normalized(spark: SparkSession, sf: str) -> DataFrame:
    docs = Tables(spark, sf).documents.select("doc_id", "text")
    return mem.dedup_normalized(docs, rank="doc_id")


@register
def list_datasets(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    logged = mem.decision_docs(t.decisions)
    return mem.list_datasets(t.memory_docs.select("dataset").unionByName(logged.select("dataset")))


@register
def decision_log(spark: SparkSession, sf: str) -> DataFrame:
    return mem.decision_docs(Tables(spark, sf).decisions).select("dataset", "doc_id", "text")


@register
def forget_dataset(spark: SparkSession, sf: str) -> DataFrame:
    kept = mem.forget_datasets(_docs(spark, sf), FORGET_DATASETS)
    return kept.groupBy("dataset").agg(F.count("*").alias("n_docs"))


@register
def forget_file(spark: SparkSession, sf: str) -> DataFrame:
    """Forget every path that a later scan no longer has."""
    t = Tables(spark, sf)
    gone = sn.snapshot_diff(t.snap_old, t.snap_new).filter(F.col("change_type") == "deleted")
    number = F.regexp_extract("path", r"(\d+)\.md$", 1)
    paths = gone.select(number.alias("doc_id"))
    return mem.forget_files(t.memory_docs, paths, path="doc_id").select("dataset", "doc_id", "path")


@register
def forget_file_substring(spark: SparkSession, sf: str) -> DataFrame:
    return mem.forget_file_substring(_docs(spark, sf), FORGET_PATH).select("dataset", "doc_id", "path")


@register
def forget_tag(spark: SparkSession, sf: str) -> DataFrame:
    docs = Tables(spark, sf).documents.withColumn("tag", F.col("lang"))
    store = MemoryStore(spark, work_dir(spark, "store")).create()
    store.ingest(docs.select(
        F.col("source").alias("dataset"), F.col("doc_id").cast("string").alias("doc_id"), F.lit("file").alias("kind"),
        F.lit(None).cast("string").alias("path"), "tag", "text",
    ))
    store.forget_tags(FORGET_TAGS)
    return store.docs().select(F.col("doc_id").cast("bigint").alias("doc_id"), "tag")


@register
def forget_all(spark: SparkSession, sf: str) -> DataFrame:
    store = MemoryStore(spark, work_dir(spark, "store")).create()
    store.ingest(_docs(spark, sf))
    before = F.lit(store.docs().count()).alias("docs_before")
    store.forget_all()
    return store.create().docs().agg(before, F.count("*").alias("docs_after"))


@register
def refresh_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The first scan stored, then refreshed with the second one."""
    t = Tables(spark, sf)

    def as_docs(files: DataFrame) -> DataFrame:
        return files.select(
            fi.dataset_name(F.col("repo")).alias("dataset"), F.col("path").alias("doc_id"),
            F.lit("file").alias("kind"), "path", F.col("content").alias("text"),
        )

    store = MemoryStore(spark, work_dir(spark, "store")).create()
    old, new = as_docs(t.snap_old), as_docs(t.snap_new)
    store.ingest(old)
    store.refresh(new)
    return store.docs().select("dataset", "doc_id", "text")


@register
def remember_corpus(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    docs = rm.remember(t.code_files, t.commits, t.commit_files)
    return docs.select("dataset", "doc_id", "kind", F.sha2(tx.redact(F.col("text")), 256).alias("sha256"))


@register
def decision_timeline(spark: SparkSession, sf: str) -> DataFrame:
    logged = Tables(spark, sf).decisions.filter(F.col("text") != "")
    recent = mem.recent_decisions(logged, TIMELINE_ROWS)
    return recent.select("id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "text")


@register
def memory_status(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    commits = t.commits.select(
        fi.dataset_name(F.col("repo")).alias("dataset"), F.lit("commit").alias("kind"), F.col("authored_ts").alias("ingested_at")
    )
    logged = t.decisions.filter(F.col("text") != "").select(
        F.lit("adr_decision").alias("dataset"), F.lit("decision").alias("kind"), F.col("ts").alias("ingested_at")
    )
    # A file's time is planted from its number.
    files = t.memory_docs.select("dataset", "kind", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_no")).alias("ingested_at"))
    status = mem.memory_status(commits.unionByName(logged).unionByName(files))
    return status.select("dataset", "kind", "n_docs", F.date_format("last_ingested_at", "yyyy-MM-dd HH:mm:ss").alias("last"))


@register
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """The newer half of the events first, then in a second run the older half: none is too late."""
    at = work_dir(spark, "stream")
    store = MemoryStore(spark, f"{at}/memory").create()
    events = sd.decisions_from_events(Tables(spark, sf).events)
    middle = events.agg(F.timestamp_seconds((F.unix_timestamp(F.min("ts")) + F.unix_timestamp(F.max("ts"))) / 2).alias("middle"))
    events = events.join(middle, F.lit(True))  # one row
    for half in (F.col("ts") >= F.col("middle"), F.col("ts") < F.col("middle")):
        events.filter(half).drop("middle").write.mode("append").parquet(f"{at}/log")
        sd.stream_decisions(sd.read_stream(spark, f"{at}/log", "*.parquet"), store, f"{at}/checkpoint")
    return store.docs().select("dataset", "doc_id", "text")


# ---- graph ----------------------------------------------------------------------------


@register
def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    nodes = gr.graph_nodes(_symbols(spark, sf))
    return nodes.select("repo", "id", "grp", "label", "title", "path", "shape", F.col("size").cast("bigint").alias("size"))


@register
def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return gr.graph_edges(_symbols(spark, sf)).select("repo", "src", "dst", "label")


@register
def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    return gr.graph_stats(_symbols(spark, sf))


@register
def digest_rows(spark: SparkSession, sf: str) -> DataFrame:
    return gr.digest_rows(_symbols(spark, sf)).orderBy("path")


@register
def graph_json(spark: SparkSession, sf: str) -> DataFrame:
    # One pass over the sources: both payloads come from the stored symbols of a scan.
    at = work_dir(spark, "symbols")
    _symbols(spark, sf).write.parquet(at)
    symbols = spark.read.parquet(at)
    return gr.node_json(gr.graph_nodes(symbols)).unionByName(gr.edge_json(gr.graph_edges(symbols)))


@register
def graph_filter(spark: SparkSession, sf: str) -> DataFrame:
    return gr.filter_nodes(gr.graph_nodes(_symbols(spark, sf)), GRAPH_FILTER).select("repo", "id", "label")


@register
def prune_stale(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes left after some files have moved away."""
    moved = F.when(F.col("doc_id") % 17 == 0, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    current = _code(spark, sf).select("repo", moved.alias("path"))
    return gr.prune_stale(gr.graph_nodes(_symbols(spark, sf)), current).select("repo", "id")


@register
def graph_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of the stored graph of an earlier state, refreshed with the scan of today.

    Before, some files stood elsewhere, some read otherwise and some did not exist.
    """
    code = _code(spark, sf)
    moved = F.when(F.col("doc_id") % 17 == 0, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    edited = F.when(F.col("doc_id") % 10 == 0, F.concat("content", F.lit("\nclass Earlier: pass"))).otherwise(F.col("content"))
    before = code.filter(F.col("doc_id") % 13 != 0).select("repo", moved.alias("path"), edited.alias("content"))
    graph = GraphStore(spark, f"{work_dir(spark, 'graph')}/graph").create()
    graph.refresh(before)
    graph.refresh(code.select("repo", "path", "content"))
    return graph.nodes().select("repo", "id", "grp", "label", "title", "path", "shape", F.col("size").cast("bigint").alias("size"))


@register
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    return sn.snapshot_diff(t.snap_old, t.snap_new)


@register
def importers_of(spark: SparkSession, sf: str) -> DataFrame:
    return gr.importers_of(sy.import_rows(_symbols(spark, sf), ("repo", "path")))


@register
def recall_with_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Best chunks of the code memory with the symbols of their files."""
    code = _code(spark, sf)
    docs = code.select(
        fi.dataset_name(F.col("repo")).alias("dataset"), F.col("path").alias("doc_id"), "repo", "path", F.col("content").alias("text")
    )
    top = written(mem.recall(mem.ingest(docs), _question(spark, sf), k=5), "top")
    # Only the files of the k best chunks are parsed.
    hits = top.select("repo", "path").distinct().collect()
    found = reduce(or_, [(F.col("repo") == h.repo) & (F.col("path") == h.path) for h in hits], F.lit(False))
    symbols = written(sy.extract_symbols(rm.scanned_files(code.filter(found)).select("repo", "path", "content")), "symbols")
    found = mem.with_graph(top, gr.graph_edges(symbols), gr.graph_nodes(symbols))
    return found.select("rank", "file", "id", "grp", "label")


# ---- imports --------------------------------------------------------------------------


def _packages(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Files of the planted packages and their imports as edges, from the stored symbols of a scan."""
    files = rm.scanned_files(Tables(spark, sf).package_files).select("repo", "path", "content")
    at = work_dir(spark, "packages")
    im.import_edges(files, sy.import_rows(sy.extract_symbols(files), ("repo", "path"))).write.parquet(at)
    return files, spark.read.parquet(at)


@register
def import_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _packages(spark, sf)[1].withColumn("inside", F.col("inside").cast("bigint"))


@register
def importers_closure(spark: SparkSession, sf: str) -> DataFrame:
    """Every importer of every file and module, through any number of files."""
    return im.importers_closure(_packages(spark, sf)[1])


@register
def recall_import_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Best chunks of the packages with the files up to two imports away."""
    files, edges = _packages(spark, sf)
    docs = files.select(fi.dataset_name(F.col("repo")).alias("dataset"), F.col("path").alias("doc_id"), "repo", "path", F.col("content").alias("text"))
    top = mem.recall(mem.ingest(docs), _question(spark, sf), k=5)
    found = im.import_neighbours(top, edges, hops=2)
    return found.select("rank", "repo", "file", "hops", F.array_join("via", " > ").alias("via"))
