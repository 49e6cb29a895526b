"""Ranked search against a plain scoring of every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from codemem.llm import lexical
from tests.llm.test_operators import LOWER, SCHEMA, odd_texts, prose, rows_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, score long, rank int, terms string"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(rows, items, k=10):
    held = [(r[0], Counter(terms(r[1]))) for r in rows]
    held = [(d, c) for d, c in held if c]
    total = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in {(i[0], i[1]) for i in items}:
        scores = []
        for d, c in held:
            m = 10 + (90 * sum(c.values()) * len(held)) // total
            score = sum(
                math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in set(terms(text)) if t in c
            )
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, n + 1, d, -s) for n, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    found = rows_of(odd_texts() + ["copy of one text"] * 30 + [prose(300 + i % 7, 20 + i) for i in range(60)])
    return [*found, found[8], found[8]]


@pytest.fixture(scope="module")
def items():
    texts = [None, "", "...", prose(2, 30), prose(300, 12) + " ONE copy", "é テキスト sun", prose(1, 4000), "nowhere-to-be-found"]
    made = [(None if i == 4 else i, t, 1, 1, "x") for i, t in enumerate(texts)]
    return [*made, made[3], (5, "one text", 1, 1, "x")]


@pytest.mark.parametrize("shard, block", [(4096, 1 << 18), (8, 64)])
def test_every_item_finds_its_best(spark, rows, items, shard, block):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = lexical.search(docs, spark.createDataFrame(items, ITEMS), shard=shard, terms=block)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows, items)


def test_no_rows(spark, rows, items):
    docs, asked = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, ITEMS)
    assert lexical.search(docs.limit(0), asked).collect() == []
    assert lexical.search(docs, asked.limit(0)).collect() == []


def test_treap_against_the_whole_grid():
    rng = np.random.default_rng(5)
    for rows, columns in ((1, 1), (3, 40), (50, 7), (90, 130)):
        grid = rng.integers(1, 60, (rows, columns)) * (rng.random((rows, columns)) < 0.2)
        r, c = np.nonzero(grid)
        ids = rng.permutation(columns) * 3
        treap = lexical.Treap(r, c, grid[r, c], ids)
        for _ in range(20):
            asked = rng.choice(rows, rng.integers(1, rows + 1), replace=False)
            weights = rng.integers(1, 9, len(asked))
            scores = weights @ grid[asked]
            want = sorted((-s, d) for s, d in zip(scores.tolist(), ids.tolist()) if s > 0)[:6]
            got = treap.search(asked, weights, 6)
            assert [(-s, d) for s, d in zip(*(x.tolist() for x in got))] == want


def test_few_ranges_are_opened_for_a_rare_term():
    n = 4096
    rows, columns = np.array([0] * n + [1]), np.array([*range(n), 1234])
    values = np.array([5] * n + [900])
    treap = lexical.Treap(rows, columns, values, np.arange(n))
    opened = []
    children = treap.children
    treap.children = lambda nodes, quadrant: opened.append(len(nodes)) or children(nodes, quadrant)
    lexical.OPEN, old = 1, lexical.OPEN
    try:
        scores, ids = treap.search(np.array([0, 1]), np.array([1, 10]), 1)
    finally:
        lexical.OPEN = old
    assert (scores.tolist(), ids.tolist()) == ([9005], [1234]) and sum(opened) < n // 8
