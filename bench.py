"""Times the headline queries and prints one JSON line.

Each query is run in full into a sink that drops the rows.  A first pass over the
smallest tables starts the JVM code paths and the Python workers.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from codemem.plans.queries import REGISTRY
from codemem.plans.store import MemoryStore
from codemem.plans.views import Tables
from codemem.session import local_session, work_dir

HEADLINE = (
    "redact_secrets",
    "filter_gitignore",
    "dedup_normalized",
    "chunk_documents",
    "ingest_docs",
    "recall_topk",
    "recall_all_datasets",
    "recall_per_dataset",
    "recall_batch",
    "recall_vectors",
    "snapshot_diff",
    "incremental_files",
    "symbols_all",
    "py_symbols",
    "js_functions",
    "symbol_summary",
    "comments_all",
    "comment_log",
    "commits_latest",
    "commit_docs",
    "graph_nodes",
    "graph_stats",
    "remember_corpus",
)


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def stored_recall(spark, sf_dir: str) -> dict[str, float]:
    """Ingest once, then one question and a batch of questions against what is stored."""
    tables = Tables(spark, sf_dir)
    store = MemoryStore(spark, work_dir(spark, "bench")).create()
    seconds = {}

    def timed(name: str, call) -> None:
        start = time.perf_counter()
        call()
        seconds[name] = time.perf_counter() - start

    item = tables.benchmark.orderBy("item_id").first()["text"]
    asked = tables.benchmark.selectExpr("item_id AS query_id", "text")
    timed("store_ingest", lambda: store.ingest(tables.memory_docs))
    timed("store_recall", lambda: store.recall(item).collect())
    timed("store_recall_scoped", lambda: store.recall(item, datasets=["codemem_src0"]).collect())
    timed("store_recall_batch", lambda: store.recall_batch(asked).collect())
    return seconds


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "codemem-bench")
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    names = sys.argv[1:] or HEADLINE
    for name in names:
        run(spark, name, warm_dir if os.path.isdir(warm_dir) else sf_dir)
    seconds = {name: run(spark, name, sf_dir) for name in names}
    if not sys.argv[1:]:
        if os.path.isdir(warm_dir):
            stored_recall(spark, warm_dir)
        seconds |= stored_recall(spark, sf_dir)
    seconds = {name: round(value, 3) for name, value in seconds.items()}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
