"""Exact top-k search by inner product: one KD-tree per shard, searched best first.

Vectors are dealt to shards of bounded size.  Each shard builds a KD-tree: median splits along the
widest dimension, with a tight box and the smallest id at every node.  The best score that a box
can hold for a query is the sum, over the dimensions, of the better of its two ends.  Nodes are
opened best bound first, and a node is passed over when it can't beat the k-th best score known
so far.  That score travels: a first round searches each query's own shard only, and its k-th
score is the bound with which the query visits all other shards.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from codemem.llm.common import arrow_type, cut

SHARD = 4096
LEAF = 64


class KdTree:
    """Nodes in arrays: rows ``begin`` to ``end`` of the ordered vectors, boxes, smallest ids, children."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        self.nodes: list[tuple] = []
        todo = [(0, len(ids), -1, 0)] if len(ids) else []
        children: dict[tuple[int, int], int] = {}
        while todo:
            begin, end, parent, side = todo.pop()
            own = vectors[order[begin:end]]
            low, high = own.min(axis=0), own.max(axis=0)
            me = len(self.nodes)
            children[parent, side] = me
            wide = high - low
            split = end - begin > leaf and wide.max() > 0
            self.nodes.append([begin, end, low, high, int(ids[order[begin:end]].min()), None, None])
            if split:
                middle = (end - begin) // 2
                within = np.argpartition(own[:, int(wide.argmax())], middle)
                order[begin:end] = order[begin:end][within]
                todo += [(begin + middle, end, me, 1), (begin, begin + middle, me, 0)]
        for (parent, side), me in children.items():
            if parent >= 0:
                self.nodes[parent][5 + side] = me
        self.ids, self.vectors = ids[order], vectors[order]

    def bound(self, node: int, query: np.ndarray) -> int:
        _, _, low, high, *_ = self.nodes[node]
        return int(np.maximum(query * low, query * high).sum())

    def search(self, query: np.ndarray, k: int, own: int, floor: int | None = None) -> list[tuple[int, int]]:
        """The ``k`` best ``(score, id)`` but those of id ``own``, ties to smaller ids.

        Whatever scores below ``floor`` may be left out.
        """
        best: list[tuple[int, int]] = []  # a heap of (score, -id), the worst first
        if not self.nodes:
            return []
        queue = [(-self.bound(0, query), self.nodes[0][4], 0)]
        while queue:
            bound, least, node = heapq.heappop(queue)
            if floor is not None and -bound < floor:
                break
            if len(best) == k:
                if -bound < best[0][0]:
                    break
                if (-bound, -least) < best[0]:
                    continue
            begin, end, _, _, _, left, right = self.nodes[node]
            if left is not None:
                for child in (left, right):
                    heapq.heappush(queue, (-self.bound(child, query), self.nodes[child][4], child))
                continue
            scores = self.vectors[begin:end] @ query
            ids = self.ids[begin:end]
            near = np.flatnonzero(ids != own)
            if len(best) == k:
                near = near[scores[near] >= best[0][0]]
            if len(near) > k:
                near = near[np.lexsort((ids[near], -scores[near]))[:k]]
            for i in near:
                x = (int(scores[i]), -int(ids[i]))
                if len(best) < k:
                    heapq.heappush(best, x)
                elif x > best[0]:
                    heapq.heapreplace(best, x)
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def whole_vectors(rows: DataFrame, scale: int = 1024) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of every component, without vectors that hold null, NaN or infinity."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("parts"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("parts").isNotNull() & F.coalesce(F.forall("parts", sound), F.lit(False)))
    return rows.select("vec_id", F.transform("parts", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


FOUND = "query_id long, vec_id long, score long"


def _visit(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Searches the shard of each row of ``queries`` (shard, vec_id, v, floor).

    A task reads the shards that are dealt to it one after the other: first a shard's vectors, of
    which it builds the tree, then its queries, which stream past.
    """
    none = F.lit(None).cast("long")
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select("shard", F.lit(0).alias("kind"), "vec_id", "v", none.alias("floor")).union(queries.select("shard", F.lit(1).alias("kind"), "vec_id", "v", "floor"))
    rows = rows.repartition(tasks, "shard").sortWithinPartitions("shard", "kind", "vec_id")
    schema = arrow_type(FOUND)

    def run(batches):
        held: dict[int, tuple[list, list]] = {}
        at, trees = None, {}
        for batch in batches:
            shard, kind, ids, v, floor = (c.to_pylist() if i != 3 else c for i, c in enumerate(batch.columns))
            out: list[tuple[int, int, int]] = []
            lists = v.to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                if shard[i] != at:
                    at, held, trees = shard[i], {}, {}
                if kind[i] == 0:
                    own = held.setdefault(len(lists[i]), ([], []))
                    own[0].append(ids[i])
                    own[1].append(lists[i])
                    continue
                width = len(lists[i])
                if width not in trees:  # vectors of another length have no product with this query
                    own = held.get(width, ([], []))
                    trees[width] = KdTree(np.array(own[0], np.int64), np.array(own[1], np.int64).reshape(len(own[0]), width))
                out += [(ids[i], found, score) for score, found in trees[width].search(np.asarray(lists[i], np.int64), k, ids[i], floor[i])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    return rows.mapInArrow(run, FOUND)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, shard: int = SHARD) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of each query with all rows.

    ``vectors`` and ``queries`` hold ``vec_id, v`` (whole numbers); a query's own id is no
    candidate; ties go to the smaller id.  Repeated rows are candidates each.  Fewer rows than
    ``k`` give all; vectors of different length have no score; no rows give no rows.
    """
    vectors = cut(vectors)
    shards = max(1, -(-vectors.count() // shard))
    place = F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("long")
    dealt = vectors.withColumn("shard", place)
    queries = cut(queries.dropDuplicates(["vec_id", "v"]))
    home = _visit(dealt, queries.select(place.alias("shard"), "vec_id", "v", F.lit(None).cast("long").alias("floor")), k)
    home = cut(home)
    floors = home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), "floor")
    others = queries.join(floors, "vec_id", "left").withColumn("home", place)
    others = others.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).where("shard <> home")
    found = home.union(_visit(dealt, others, k))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
