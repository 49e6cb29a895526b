import datetime as dt
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from codemem.functions import vectors as vx
from codemem.operators import memory as mem

DOCS = "dataset STRING, doc_id STRING, text STRING"


def random_text(rng, words):
    vocabulary = ["load", "save", "Été", "x_1", "naïve", "42", "graph", "token", "a", "b", "c"]
    return "".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "  ", ", ", "\t", " "]) for _ in range(words))


@pytest.fixture(scope="module")
def corpus(spark):
    """A third of the documents sit in one dataset; some are copies."""
    rng = random.Random(3)
    rows = []
    for i in range(120):
        dataset = "hot" if i % 3 == 0 else f"d{i % 7}"
        text = "same words here" if i % 10 == 0 else random_text(rng, rng.randint(0, 60))
        rows.append((dataset, f"{i:03d}", text))
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("size", [1, 7, 256])
def test_chunks_joined_give_the_text(frame, size):
    rng = random.Random(size)
    texts = ["", "   ", "one", " lead and trail \n", *(random_text(rng, n) for n in (1, 5, 7, 8, 300, 2000))]
    docs = frame([(str(i), t) for i, t in enumerate(texts)], "doc_id STRING, text STRING")
    got: dict = {}
    for r in mem.chunk_documents(docs, size).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    for i, text in enumerate(texts):
        parts = got.get(str(i), [])
        assert "".join(parts) == (text if text.strip() else "")
        assert len(parts) == math.ceil(len(text.split()) / size)
        assert all(len(p.split()) == size for p in parts[:-1])


def test_embedding_is_a_unit_count_vector(frame):
    rows = frame([(0, "a b A c_1 été"), (1, ""), (2, None)], "i INT, text STRING")
    out = [r.e for r in rows.select("i", vx.hash_embedding(F.col("text")).alias("e")).orderBy("i").collect()]
    assert all(len(e) == vx.DEFAULT_DIM for e in out)
    assert sorted(x for x in out[0] if x) == pytest.approx([1 / math.sqrt(7)] * 3 + [2 / math.sqrt(7)])
    assert not any(out[1]) and not any(out[2])


def chunk_table(corpus):
    return mem.ingest(corpus, max_tokens=20).cache()


def brute_force(rows, query, k, where=lambda r: True):
    scored = [
        (-round(float(np.dot(np.asarray(r.embedding, float), query) / np.linalg.norm(query)), 6) + 0.0, r.dataset, r.doc_id, r.chunk_no)
        for r in rows if where(r)
    ]
    return [(-s, d, i, c) for s, d, i, c in sorted(scored)[:k]]


def as_tuples(rows):
    return [(r.score, r.dataset, r.doc_id, r.chunk_no) for r in rows]


def test_recall_equals_brute_force(spark, corpus):
    chunks = chunk_table(corpus)
    rows = chunks.collect()
    query = np.asarray(mem.query_vector(spark, "graph load été"), float)
    top = mem.recall(chunks, list(query), 5).orderBy("rank").collect()
    assert [r["rank"] for r in top] == [1, 2, 3, 4, 5]
    assert as_tuples(top) == brute_force(rows, query, 5)
    scoped = mem.recall(chunks, list(query), 4, ["hot"]).orderBy("rank").collect()
    assert as_tuples(scoped) == brute_force(rows, query, 4, lambda r: r.dataset == "hot")
    per = mem.recall_per_dataset(chunks, list(query), 2).collect()
    for name in {r.dataset for r in rows}:
        got = sorted((r for r in per if r.dataset == name), key=lambda r: r["rank"])
        assert as_tuples(got) == brute_force(rows, query, 2, lambda r: r.dataset == name)


@pytest.mark.parametrize("block", [4096, 3])
def test_batch_recall_equals_single_recall(spark, corpus, block):
    chunks = chunk_table(corpus)
    texts = ["graph load", "same words here", "save 42 token", "nothing known", "", "naïve x_1", "a b c"]
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id INT, text STRING")
    queries = mem.hash_embedder()(asked)
    got = mem.recall_batch(chunks, queries, 4, query_block=block).collect()
    for i, text in enumerate(texts):
        single = mem.recall(chunks, mem.query_vector(spark, text), 4).orderBy("rank").collect()
        mine = sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])
        assert as_tuples(mine) == as_tuples(single), text


def test_batch_recall_of_nothing(spark, corpus):
    chunks = chunk_table(corpus)
    none = spark.createDataFrame([], "query_id INT, embedding ARRAY<FLOAT>")
    assert mem.recall_batch(chunks, none).count() == 0
    some = spark.createDataFrame([(1, [1.0] * vx.DEFAULT_DIM)], "query_id INT, embedding ARRAY<FLOAT>")
    assert mem.recall_batch(chunks.limit(0), some).count() == 0


def test_dense_vectors_of_any_length(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(60, 100))
    vectors[7] = 0
    rows = [("d", f"{i:02d}", 0, [float(x) for x in v]) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "dataset STRING, doc_id STRING, chunk_no BIGINT, embedding ARRAY<DOUBLE>")
    query = rng.normal(size=100)
    lengths = np.linalg.norm(vectors, axis=1) * np.linalg.norm(query)
    scores = np.round(np.divide(vectors @ query, lengths, out=np.zeros(60), where=lengths > 0), 6)
    want = sorted(range(60), key=lambda i: (-scores[i], i))[:5]
    got = mem.recall(table, list(map(float, query)), 5, unit_vectors=False).orderBy("rank").collect()
    assert [int(r.doc_id) for r in got] == want
    asked = spark.createDataFrame([(1, [float(x) for x in query])], "query_id INT, embedding ARRAY<DOUBLE>")
    batch = mem.recall_batch(table, asked, 5, unit_vectors=False).orderBy("rank").collect()
    assert [int(r.doc_id) for r in batch] == want


def test_model_plugs_in(spark, corpus):
    embedder = mem.model_embedder(lambda texts: np.asarray([[len(t), t.count("a")] for t in texts]))
    rows = mem.ingest(corpus, embedder).collect()
    assert rows and all(r.embedding == [len(r.text), r.text.count("a")] for r in rows)


def test_first_of_near_literal_copies_stays(frame):
    texts = ["Got it.", "GOT  it.", " Some\nText ", "some text", "", " \t", "other", "SOME   text ", "Other"]
    rows = frame([(i + 1, t) for i, t in enumerate(texts)], "rank BIGINT, text STRING")
    assert [r["rank"] for r in mem.dedup_normalized(rows).orderBy("rank").collect()] == [3, 7]


def test_copies_that_make_a_third_of_all_rows(spark):
    rows = spark.range(30_000).select(
        (F.col("id") + 1).alias("rank"),
        F.when(F.col("id") % 3 == 0, "One  Copy").otherwise(F.concat(F.lit("text "), F.col("id") % 500)).alias("text"),
    )
    kept = mem.dedup_normalized(rows)
    assert kept.count() == 501 and kept.agg(F.min("rank")).first()[0] == 1


def test_answer(frame):
    answer = lambda rows: mem.answer_text(frame(rows, "rank BIGINT, text STRING")).first().answer
    assert answer([(2, "B"), (1, "A x"), (3, " a  X"), (4, "got it.")]) == "A x\n\nB"
    assert answer([(1, "Got It."), (2, " ")]) == mem.NO_TEXTS
    assert answer([]) == mem.NO_RESULTS


def test_decisions(frame):
    at = dt.datetime(2024, 1, 1, 0, 0, 7, 900000)
    table = frame([(1, at, "use x"), (2, at, ""), (3, at + dt.timedelta(days=1), "use y")], "id BIGINT, ts TIMESTAMP, text STRING")
    rows = mem.decision_docs(table).orderBy("doc_id").collect()
    assert [(r.dataset, r.text) for r in rows] == [
        ("adr_decision_1704067207", "Architectural Decision Record:\nuse x"),
        ("adr_decision_1704153607", "Architectural Decision Record:\nuse y"),
    ]
    assert [r.id for r in mem.recent_decisions(table, 2).collect()] == [3, 2]


def test_forgetting(frame):
    docs = frame(
        [("d", "1", "a.py", "File Path: a.py\nx", "t1"), ("d", "2", "a.py.bak", "File Path: a.py.bak\nx", "t2"),
         ("d", "3", None, "log\nFile Path: a.py\n", None), ("a_py", "4", "z", "z", "t1"), (None, "5", "q", "q", "t3")],
        "dataset STRING, doc_id STRING, path STRING, text STRING, tag STRING",
    )
    left = lambda df: {r.doc_id for r in df.collect()}
    assert left(mem.forget_files(docs, frame([("a.py",)], "path STRING"))) == {"2", "3", "4", "5"}
    known = docs.filter("dataset is not null")
    assert left(mem.forget_file_substring(known, "a.py")) == set()
    assert left(mem.forget_file_substring(known, "z")) == {"1", "2", "3"}
    assert left(mem.forget_datasets(docs, ["d", "unknown"])) == {"4", "5"}
    assert left(mem.forget_tag(docs, ["t1", "t3"])) == {"2", "3"}
    assert {r.dataset for r in mem.list_datasets(docs).collect()} == {"d", "a_py"}


def test_terms_follow_unicode_words():
    assert re.findall(r"\w+", "naïve_1 x-y") == ["naïve_1", "x", "y"]
