"""The plans of operators that decide how a job scales."""

import pytest

from codemem.operators import commits as ci, files as fi, graph as gr, memory as mem, snapshots as sn, symbols as sy
from codemem.plans.queries import REGISTRY
from codemem.plans.store import MemoryStore
from codemem.plans.views import Tables
from codemem.session import work_dir


@pytest.fixture(scope="module")
def t(spark, sf_dir):
    return Tables(spark, sf_dir)


NATIVE = [
    "filter_ignored_dirs", "filter_text_files", "filter_gitignore", "filter_trivial", "redact_secrets", "dataset_names",
    "js_classes", "go_functions", "rust_types", "comments_all", "comment_log", "commit_headers", "commit_docs",
    "chunk_documents", "dedup_normalized", "snapshot_diff", "changed_files", "incremental_files", "forget_file",
]


@pytest.mark.parametrize("name", NATIVE)
def test_native_operators_stay_in_the_jvm(spark, sf_dir, plan, name):
    text = plan(REGISTRY[name](spark, sf_dir))
    assert "Python" not in text and "InArrow" not in text and "InPandas" not in text


@pytest.mark.parametrize("name", [n for n in REGISTRY if n not in ("scan_corpus", "index_write", "forget_all", "refresh_upsert", "stream_ingest")])
def test_no_cross_joins_and_no_unbounded_sorts(spark, sf_dir, plan, name):
    text = plan(REGISTRY[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "SinglePartition" not in text or name in ("graph_stats", "recall_answer_text", "recall_topk", "recall_all_datasets", "recall_with_graph")


def shuffles(text):
    # The source tables are spread over the cores first when they come in few splits.
    return text.count("Exchange hashpartitioning") + text.count("Exchange rangepartitioning")


def test_in_row_operators_do_not_shuffle(t, plan):
    files = t.code_files
    symbols = sy.regex_symbols(files.select("repo", "path", "content"))
    from codemem.operators import comments as cm

    for df in (cm.comment_logs(files), gr.graph_nodes(symbols), gr.graph_edges(symbols), gr.digest_rows(symbols),
               mem.ingest(t.memory_docs), fi.outside_ignored_dirs(t.paths)):
        assert shuffles(plan(df)) == 0


def test_top_k_is_taken_in_each_task(spark, t, plan):
    chunks = mem.ingest(t.memory_docs)
    query = mem.query_vector(spark, "some words")
    assert "TakeOrderedAndProject" in plan(mem.recall(chunks, query))
    for df in (mem.recall_per_dataset(chunks, query), ci.latest_commits(t.commits), mem.recall_batch(chunks, mem.hash_embedder()(t.benchmark.selectExpr("item_id AS query_id", "text")))):
        text = plan(df)
        assert text.count("WindowGroupLimit") == 2 and "Partial" in text
    assert "TakeOrderedAndProject" in plan(ci.latest_commits(t.commits, 5, per_repo=False))


def test_the_recall_behind_a_graph_answer_runs_once(spark, t, plan):
    files = t.code_files.selectExpr("repo AS dataset", "path AS doc_id", "repo", "path", "content AS text")
    top = mem.recall(mem.ingest(files), mem.query_vector(spark, "some words"))
    symbols = sy.regex_symbols(t.code_files.select("repo", "path", "content"))
    assert "ArrowEvalPython" not in plan(mem.with_graph(top, gr.graph_edges(symbols), gr.graph_nodes(symbols)))
    assert "documents.parquet" not in plan(REGISTRY["recall_with_graph"](t.spark, t.sf_dir))


def test_extraction_runs_once_below_an_explode(t, plan):
    rows = sy.class_rows(sy.regex_symbols(t.code_files.select("path", "content")))
    assert "Filter (size(" not in plan(rows)
    logs = plan(REGISTRY["comment_log"](t.spark, t.sf_dir))
    assert logs.count("<!--") == plan(REGISTRY["comments_all"](t.spark, t.sf_dir)).count("<!--")


def test_only_hashes_are_shuffled_by_the_diff(t, plan):
    text = plan(sn.snapshot_diff(t.snap_old, t.snap_new))
    tops = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert len(tops) == 1 and "Join" not in text


def test_scans_read_only_the_columns_they_need(t, plan):
    text = plan(mem.list_datasets(t.memory_docs))
    assert "ReadSchema: struct<source:string>" in text


def test_a_change_set_is_joined_as_a_semi_join(t, plan):
    assert "LeftSemi" in plan(fi.incremental_files(t.snap_new, t.snap_old))


def test_recall_in_a_dataset_reads_its_partition_only(spark, t, plan):
    store = MemoryStore(spark, work_dir(spark, "test-plan")).create()
    store.ingest(t.memory_docs)
    text = plan(store.chunks(["codemem_src0"]))
    assert "scope IN (codemem_src0)" in text.replace("#", " #").replace(" #", "#") or "PartitionFilters: [isnotnull(scope" in text
