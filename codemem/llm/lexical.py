"""Ranked lexical search over a K2-treap of the term-document grid.

The grid has one row for each term that the items hold, the most frequent terms first, and one column
for each document of a shard, by length.  A cell that holds a term's occurrences in a document has its
impact.  The grid is cut into quadrants again and again; a node of the tree is a square that is not
empty, with a mask of its quadrants and the largest impact in it.  Children stand in the order of
their squares, so a child's place is the number of quadrants before it (a rank, kept for each node).

An item descends along the rows of all its terms at once.  A range of documents stands for one node on
each row path; the sum of their weighted maxima is the most that a document of the range can score.
Ranges are opened best first, several at a time, and split in two.  A range of one document has its
exact score.  Ranges that cannot beat the k-th best document known so far are passed over.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from codemem.llm.common import Words, arrow_type, cut, rounds, stored

# Documents in a shard, and occurrences of terms in documents after which a shard is closed.
SHARD = 4096
POINTS = 1 << 20
# Terms of the items that are searched in one pass over the documents.
TERMS = 1 << 18
# Ranges times terms that are opened at once.
OPEN = 1 << 14
NO_ID = np.iinfo(np.int64).max

SHARDS = (
    "texts long, words long, ids array<long>, sizes array<long>, term array<int>, place array<int>, count array<int>, "
    "df_term array<int>, df array<int>"
)
ASKED = "item_id long, number long, terms array<long>"


def _term_bytes() -> np.ndarray:
    """Bytes of terms: digits, letters, and all of characters beyond ASCII."""
    inner = np.zeros(256, dtype=bool)
    inner[48:58] = inner[65:91] = inner[97:123] = inner[128:] = True
    return inner


# ---- grid -----------------------------------------------------------------------------


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of whole numbers below 2^32, with a gap after each."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


_ONES = np.array([bin(m).count("1") for m in range(16)], np.int32)


class Treap:
    """Squares of a grid, level by level from the whole to single cells: masks, first children, maxima.

    ``ids`` are the columns' documents.  The last node is an empty square that leads to itself.
    """

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, ids: np.ndarray):
        self.ids = ids
        side = max(int(rows.max(initial=0)), len(ids) - 1, 1)
        self.depth = side.bit_length()
        code = (_spread(rows) << np.uint64(1)) | _spread(columns)
        order = np.argsort(code)
        code, top = code[order], values[order].astype(np.int64)
        levels = [(np.zeros(len(code), np.uint8), np.zeros(len(code), np.int64), top)]
        for _ in range(self.depth if len(code) else 0):
            parent = code >> np.uint64(2)
            first = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
            masks = np.bitwise_or.reduceat(np.left_shift(1, (code & np.uint64(3)).astype(np.int64)).astype(np.uint8), first)
            top = np.maximum.reduceat(top, first)
            levels.append((masks, first, top))
            code = parent[first]
        levels.reverse()
        sizes = np.array([len(m) for m, _, _ in levels])
        begin = np.concatenate([[0], np.cumsum(sizes)])
        self.nodes = int(begin[-1])
        self.mask = np.concatenate([m for m, _, _ in levels] + [np.zeros(1, np.uint8)])
        self.first = np.concatenate([f + begin[i + 1] for i, (_, f, _) in enumerate(levels)] + [[self.nodes]]).astype(np.int32)
        self.top = np.concatenate([t for _, _, t in levels] + [np.zeros(1, np.int64)])
        # The smallest id of every range of documents, level by level.
        padded = np.full(1 << self.depth, NO_ID, np.int64)
        padded[: len(ids)] = ids
        least = [padded]
        while len(least[-1]) > 1:
            least.append(least[-1].reshape(-1, 2).min(axis=1))
        self.least = np.concatenate(least[::-1])  # range r of depth d is at 2^d - 1 + r

    def children(self, nodes: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        mask = self.mask[nodes]
        there = (mask >> quadrant) & 1
        before = _ONES[mask & ((1 << quadrant) - 1)]
        return np.where(there == 1, self.first[nodes] + before, self.nodes)

    def search(self, rows: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the ``k`` best documents above 0, ties to smaller ids."""
        scores, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        inside = rows < 1 << self.depth  # the others hold nothing here
        rows, weights = rows[inside], weights[inside]
        if not len(rows) or not self.nodes:
            return scores, found
        batch = max(8, OPEN // len(rows))
        depth, at = np.zeros(1, np.int64), np.zeros(1, np.int64)
        paths = np.zeros((1, len(rows)), np.int32)
        bound = (self.top[paths] * weights).sum(axis=1)
        while len(depth):
            if len(scores) == k:
                least = self.least[(1 << depth) - 1 + at]
                good = (bound > scores[-1]) | ((bound == scores[-1]) & (least < found[-1]))
                depth, at, paths, bound = depth[good], at[good], paths[good], bound[good]
                if not len(depth):
                    break
            if len(depth) > batch:
                order = np.argpartition(-bound, batch - 1)
                opened, rest = order[:batch], order[batch:]
            else:
                opened, rest = np.arange(len(depth)), np.zeros(0, np.int64)
            row_half = (rows[None, :] >> (self.depth - 1 - depth[opened])[:, None]) & 1
            new = []
            for half in (0, 1):
                paths_of = self.children(paths[opened], (row_half * 2 + half).astype(np.uint8))
                new.append((depth[opened] + 1, at[opened] * 2 + half, paths_of, (self.top[paths_of] * weights).sum(axis=1)))
            d, a, p, b = (np.concatenate(x) for x in zip(*new))
            done = (d == self.depth) & (b > 0)
            if done.any():
                scores, found = np.concatenate([scores, b[done]]), np.concatenate([found, self.ids[a[done]]])
                best = np.lexsort((found, -scores))[:k]
                scores, found = scores[best], found[best]
            more = (d < self.depth) & (b > 0)
            depth, at, paths, bound = (
                np.concatenate([old[rest], fresh[more]]) for old, fresh in ((depth, d), (at, a), (paths, p), (bound, b))
            )
        return scores, found


# ---- index ----------------------------------------------------------------------------


def _closed(parts: list[tuple], texts: int, words: int) -> dict:
    ids, sizes, term, place, count = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts) if parts else [()] * 5))
    order = np.argsort(term, kind="stable")
    term, place, count = term[order], place[order], count[order]
    df_term, df = np.unique(term, return_counts=True)
    return {"texts": [texts], "words": [words], "ids": [ids], "sizes": [sizes], "term": [term], "place": [place], "count": [count], "df_term": [df_term], "df": [df]}


def shards(docs: DataFrame, vocabulary: np.ndarray, shard: int = SHARD, points: int = POINTS) -> DataFrame:
    """Documents that hold a term of the sorted ``vocabulary`` of hashes, as shards of bounded size.

    A row is a shard: the number of documents with a term of any kind and of all their terms; ids and
    lengths of its documents; for every occurrence of a term in a document the term's place in the
    vocabulary, the document's place in the shard and the count; document frequencies.
    """
    schema = arrow_type(SHARDS)
    terms = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        inner, known = _term_bytes(), terms.value
        held, texts, words, columns, cells = [], 0, 0, 0, 0

        def row():
            made = _closed(held, texts, words)
            return pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in schema], schema=schema)

        for part, data, offsets in rounds(batches):
            found = Words(data, offsets, lower=True, inner=inner)
            texts, words = texts + int((found.count > 0).sum()), words + len(found.hash)
            if not len(known) or not len(found.hash):
                continue
            at = np.minimum(np.searchsorted(known, found.hash), len(known) - 1)
            hit = known[at] == found.hash
            cell, count = np.unique(found.row[hit] * len(known) + at[hit], return_counts=True)
            doc, term = cell // len(known), cell % len(known)
            of, place = np.unique(doc, return_inverse=True)
            ids = part.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)[of]
            held.append((ids, found.count[of], term, place + columns, count))
            columns, cells = columns + len(of), cells + len(cell)
            if columns >= shard or cells >= points:
                yield row()
                held, texts, words, columns, cells = [], 0, 0, 0, 0
        yield row()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SHARDS)


def asked_terms(items: DataFrame) -> DataFrame:
    """``item_id, number, terms``: every distinct item with a number of its own and its terms' hashes."""
    schema = arrow_type(ASKED)

    def run(batches):
        for part, data, offsets in rounds(batches):
            found = Words(data, offsets, lower=True, inner=_term_bytes())
            lists = [np.unique(found.hash[a:b]).view(np.int64) for a, b in zip(found.first[:-1], found.first[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(lists, pa.list_(pa.int64()))], schema=schema)

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    return rows.select("item_id", "text", F.xxhash64("item_id", "text").alias("number")).mapInArrow(run, ASKED).where(F.size("terms") > 0)


# ---- search ---------------------------------------------------------------------------


def term_weight(texts: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * texts + 2) / (2 * df + 1)))


def impacts(count: np.ndarray, size: np.ndarray, texts: int, words: int) -> np.ndarray:
    """Impact of ``count`` occurrences in documents of ``size`` terms."""
    known, at = np.unique(size, return_inverse=True)
    length = np.array([10 + 90 * int(n) * texts // words for n in known], np.int64)[at]
    count = count.astype(np.int64)
    return (1_000_000_000 * count) // (1000 * count + 8 * length)


def _block(written: DataFrame, asked: list, vocabulary: np.ndarray, k: int) -> DataFrame:
    """``item_id, number, doc_id, score``: the ``k`` best of every shard for a block of items."""
    spark = written.sparkSession
    total = written.agg(F.sum("texts"), F.sum("words"), F.count("*")).first()
    texts, words = int(total[0] or 0), int(total[1] or 0)
    pairs = written.select(F.arrays_zip("df_term", "df").alias("x")).select(F.explode("x").alias("x"))
    # One row for each term of the block: its number has a bound.
    df = np.zeros(len(vocabulary), np.int64)
    counted = pairs.groupBy(F.col("x.df_term").alias("t")).agg(F.sum("x.df").alias("n")).toArrow()
    df[counted.column("t").to_numpy()] = counted.column("n").to_numpy()
    weight = np.array([term_weight(texts, int(n)) if n else 0 for n in df], np.int64)
    row_of = np.empty(len(df), np.int64)
    row_of[np.argsort(-df, kind="stable")] = np.arange(len(df))
    items = []
    for r in asked:
        at = np.searchsorted(vocabulary, np.array(r["terms"], np.int64).view(np.uint64))
        at = at[weight[at] > 0]
        items.append((r["item_id"], r["number"], row_of[at], weight[at]))
    shared = spark.sparkContext.broadcast((items, row_of, texts, words))
    ddl = "item_id long, number long, doc_id long, score long"
    schema = arrow_type(ddl)

    def run(batches):
        items, row_of, texts, words = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name: batch.column(name)[i].values.to_numpy(zero_copy_only=False)
                ids, sizes = get("ids"), get("sizes")
                if not len(ids):
                    continue
                order = np.lexsort((ids, sizes))
                column = np.empty(len(ids), np.int64)
                column[order] = np.arange(len(ids))
                place = get("place")
                treap = Treap(row_of[get("term")], column[place], impacts(get("count"), sizes[place], texts, words), ids[order])
                out = []
                for item, number, rows, weights in items:
                    for score, doc in zip(*treap.search(rows, weights, k)):
                        out.append((item, number, None if doc == NO_ID else int(doc), int(score)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    # A shard is much work and few bytes: they are dealt anew, a few to a task.
    tasks = max(spark.sparkContext.defaultParallelism, -(-int(total[2]) // 2))
    return written.select("ids", "sizes", "term", "place", "count").repartition(tasks).mapInArrow(run, ddl)


def search(docs: DataFrame, items: DataFrame, k: int = 10, shard: int = SHARD, terms: int = TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents with a score above 0 for every item.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased, of whole
    texts.  Equal scores go to the smaller ``doc_id``, a null one last.  A null, empty or wordless text
    holds no term: such a document is not counted and not found, such an item has no rows.  Repeated
    documents are documents each; repeated items (same id and text) are one; items that share an id
    but not the text are ranked each by itself.  No documents or no items give no rows.  Further columns
    are not read, so their names cannot clash.  Items are searched in blocks of about ``terms`` terms;
    each block is one pass over the documents.
    """
    asked = cut(asked_terms(items))
    blocks = max(1, -(-int(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // terms))
    found = None
    for block in range(blocks):
        rows = asked.where(F.pmod("number", F.lit(blocks)) == block).orderBy("number").collect()
        lists = [np.array(r["terms"], np.int64).view(np.uint64) for r in rows]
        vocabulary = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.uint64)
        best = cut(_block(stored(shards(docs, vocabulary, shard), "lexical-shards"), rows, vocabulary, k))
        found = best if found is None else found.union(best)
    order = Window.partitionBy("item_id", "number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
