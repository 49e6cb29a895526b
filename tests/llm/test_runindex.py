"""Repeated strings against a plain count of every window, and the index against plain suffixes."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from codemem.llm import runindex
from tests.llm.test_operators import SCHEMA, odd_texts, prose, rows_of


def plain(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        starts = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(d) else 0
        left = np.frombuffer(d, np.uint8)[~gone[:-1]].tobytes()
        out.append((len(d), int(gone.sum()), starts, hashlib.sha256(left).hexdigest()))
    return out


def passages():
    shared, line = prose(50, 60), "a common line of some eighty bytes that very many of the texts hold, é and ü in it."
    texts = [prose(200 + i, 30) + " " + shared + " " + prose(300 + i, 20) for i in range(4)]
    texts += [prose(400 + i, 25) + "\n" + line + "\n" + prose(500 + i, 25) for i in range(60)]
    texts += [line * 2 + shared[:150 + i] + prose(600 + i, 3) for i in range(8)]
    inside = prose(70, 50)
    return texts + [inside + " x " + inside, "ab" * 400, "日本" * 120, prose(71, 20)[:200], prose(71, 20)[:200], prose(71, 20)[:199]]


@pytest.mark.parametrize("seed_bytes, size", [(1 << 20, 1 << 19), (600, 2000)])
def test_removed_bytes(spark, seed_bytes, size):
    rows = rows_of(odd_texts() + passages())
    rows += [rows[8], rows[8]] + [rows[25]] * 5
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = runindex.digest(runindex.without_repeats(docs, seed_bytes=seed_bytes, index_bytes=size))
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = [(r[0], *x) for r, x in zip(rows, plain([r[1] for r in rows]))]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_spans_and_bytes(spark):
    rows = rows_of(passages())
    for r in runindex.without_repeats(spark.createDataFrame(rows, SCHEMA)).collect():
        data = next((x[1] or "").encode() for x in rows if x[0] == r.doc_id)
        at, kept = 0, b""
        for s in r.spans:
            assert at <= s.low and s.high - s.low >= 200
            kept, at = kept + data[at : s.low], s.high
        assert r.kept == kept + data[at:]


def test_long_text_in_buffers(spark):
    text = prose(80, 400) + " " + prose(81, 60)
    rows = rows_of([text, prose(82, 30) + prose(81, 60), text[1000:1800]])
    found = runindex.digest(runindex.without_repeats(spark.createDataFrame(rows, SCHEMA), buffer=700))
    assert sorted(map(tuple, found.collect())) == sorted((r[0], *x) for r, x in zip(rows, plain([r[1] for r in rows])))


def test_no_rows(spark):
    assert runindex.without_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_pieces_hold_every_window_once():
    texts = [t.encode() for t in (prose(1, 300), "ab" * 300, "x" * 500, prose(2, 10))]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    p = runindex.pieces(data, offsets, 200, 32)
    own = [(int(r), int(s) + k) for r, s, n in zip(p["row"], p["start"], p["windows"]) for k in range(n)]
    assert sorted(own) == [(i, s) for i, t in enumerate(texts) for s in range(len(t) - 199)]
    # Equal windows have equal seeds.
    seeds = {}
    for r, s, n, m in zip(p["row"], p["start"], p["windows"], p["m"]):
        for k in range(n):
            assert seeds.setdefault(texts[r][s + k : s + k + 200], m) == m


def test_index_against_plain_suffixes():
    rng = np.random.default_rng(4)
    for letters, n in ((2, 40), (3, 200), (20, 300)):
        texts = [rng.integers(97, 97 + letters, int(rng.integers(1, n))).astype(np.uint8).tobytes() for _ in range(6)]
        texts += [texts[0] + texts[1], texts[2]]
        index = runindex.RunIndex(texts)
        data = index.data.tobytes()
        suffixes = [(i, data[i : data.index(b"\xff", i)]) for i in range(len(data))]

        def common(a, b):
            return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

        want = [max(common(a, b) for j, b in suffixes if j != i) for i, a in suffixes]
        assert index.statistics().tolist() == want
        order = runindex.suffix_order(index.data, index.words, index.left)
        assert [suffixes[i][1] + b"\xff" for i in order] == sorted(s + b"\xff" for _, s in suffixes)
        assert int(index.run_length.sum()) == len(data)
        # The transform is in runs, and a repetitive text has few.
    index = runindex.RunIndex([b"the same line again and again. " * 40, b"another"])
    assert len(index.run_byte) < 60
