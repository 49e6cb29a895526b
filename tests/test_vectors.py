"""Many queries at once, similarity by projection trees, and the index of stored vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codemem.functions import vectors as vx
from codemem.operators import memory as mem, nearest
from codemem.plans import vector_index
from codemem.plans.vector_index import VectorIndex
from codemem.session import work_dir

CHUNKS = "dataset string, doc_id string, chunk_no long, text string, embedding array<float>"


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


@pytest.fixture(scope="module")
def vectors():
    """Forty clusters, a third of all rows one vector, and a few zero vectors."""
    rng = np.random.default_rng(6)
    centres = unit(rng.normal(size=(40, 24)))
    rows = unit(centres[rng.integers(0, 40, 1600)] + rng.normal(0, 0.12, (1600, 24)))
    return np.concatenate([rows, np.repeat(rows[:1], 800, axis=0), np.zeros((5, 24))]).astype(np.float32)


@pytest.fixture(scope="module")
def chunks(spark, vectors):
    rows = [(f"d{i % 3}", f"{i}", i % 2, f"text {i}", v.tolist()) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, CHUNKS).repartition(6).cache()


@pytest.fixture(scope="module")
def asked(spark, vectors):
    rng = np.random.default_rng(7)
    made = unit(vectors[rng.integers(0, 1600, 60)] + rng.normal(0, 0.05, (60, 24)))
    rows = [(i, v.tolist()) for i, v in enumerate([*made, vectors[0], np.zeros(24)])]
    return spark.createDataFrame(rows, "query_id long, embedding array<float>")


def found(df):
    return sorted((r.query_id, r["rank"], r.dataset, r.doc_id, r.chunk_no, r.score) for r in df.collect())


@pytest.mark.parametrize("block", [4096, 7])
def test_blocks_of_queries(chunks, asked, block, plan):
    many = mem.recall_batch(chunks, asked, 4, query_block=block)
    # Vectors stay where they are: only the best rows move.
    text = plan(many)
    assert "FlatMapCoGroups" not in text and "Cartesian" not in text and text.count("Exchange hash") == 1
    assert found(many) == found(mem.recall_batch(chunks, asked, 4))


# ---- projection trees -----------------------------------------------------------------


def recall_of(some, exact):
    floors = {}
    for query, _, *_, score in exact:
        floors[query] = min(score, floors.get(query, 2.0))
    return sum(score >= floors[query] for query, *_, score in some) / len(exact)


@pytest.mark.parametrize("block", [20_000, 50])
def test_recall_of_similar(chunks, asked, block):
    exact = found(mem.recall_batch(chunks, asked.filter("query_id < 61"), 3))
    some = found(nearest.recall_similar(chunks, asked.filter("query_id < 61"), 3, bucket=64, block=block))
    assert recall_of(some, exact) >= 0.9
    assert [s for s in some if s[0] == 60] == [s for s in exact if s[0] == 60]  # a third of all rows tie
    assert len({s[:2] for s in some}) == len(some)


def test_nothing_meets_everything(chunks, asked):
    # Buckets that a query visits hold a part of the vectors.
    trees = nearest.fit_trees(chunks.select("embedding"), 4, bucket=64)
    assert (trees.trees, trees.depth) == (4, 5)
    rows = np.array([r.embedding for r in chunks.dropDuplicates(["embedding"]).collect()])
    places = trees.bucket(rows, 0)
    assert np.bincount(places, minlength=32).max() < len(rows) / 8
    for own, visited in zip(places, trees.visits(rows, 0, 3)):
        assert visited[0] == own and len(set(visited)) == 3


def test_similar_of_nothing(chunks, asked):
    assert nearest.recall_similar(chunks.limit(0), asked).collect() == []
    assert nearest.recall_similar(chunks, asked.limit(0)).collect() == []


# ---- index ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def index(spark, chunks):
    return VectorIndex(spark, work_dir(spark, "test-index")).build(chunks, centres=40)


@pytest.mark.parametrize("k", [1, 5, 900])
def test_index_equals_a_full_scan(index, chunks, asked, k):
    got = index.recall_batch(asked, k)
    assert found(got) == found(mem.recall_batch(chunks, asked, k))
    assert {r.text for r in got.filter("dataset = 'd0'").collect()} <= {f"text {i}" for i in range(0, 2405, 3)}


def test_index_with_few_centres_and_queries_in_blocks(spark, chunks, asked, monkeypatch):
    monkeypatch.setattr(vector_index, "TOGETHER", 20)
    small = VectorIndex(spark, work_dir(spark, "test-index")).build(chunks, centres=1)
    assert found(small.recall_batch(asked, 3)) == found(mem.recall_batch(chunks, asked, 3))
    assert small.recall([0.0] * 24, 2).count() == 2


def test_cells_are_pruned(index, vectors, plan):
    near = index.candidates(unit(vectors[5:6].astype(float)), [0.9])
    text = plan(near)
    assert "PartitionFilters: [cell" in text.replace("isnotnull(cell#", "cell#") or "PartitionFilters: [" in text and "cell#" in text.split("PartitionFilters:")[1].split("]")[0]
    assert "GreaterThanOrEqual(away" in text and "LessThanOrEqual(away" in text
    read = near.select("cell").distinct().count()
    assert 1 <= read < 20 and near.count() < len(vectors) / 2


def test_index_of_nothing(spark, chunks, asked):
    empty = VectorIndex(spark, work_dir(spark, "test-index")).build(chunks.limit(0))
    assert empty.recall_batch(asked, 3).collect() == []
    assert VectorIndex(spark, work_dir(spark, "test-index")).build(chunks).recall_batch(asked.limit(0)).collect() == []


def test_embedding_holds_few_rows_at_once():
    """Beside the vectors of a batch, what is held does not grow with the batch."""
    import tracemalloc

    import pyarrow as pa

    texts = pa.array([f"word{i} other words here {i % 7}" for i in range(10_000)])
    tracemalloc.start()
    made = next(vx.embedded(iter([texts])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(made) == 10_000 and peak < 40 << 20  # the vectors are 15 MB; all counts at once were 61 MB more
