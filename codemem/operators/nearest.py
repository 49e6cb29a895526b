"""Similar vectors by random projections: buckets of several trees, exact scores inside the buckets.

Every tree cuts the space in two again and again.  A cut runs between two rows of a bounded sample, picked
at random, at the median of the sample's projections on their difference, so that dense regions are
cut as often as thin ones.  A stored vector falls into one bucket per tree.  A query visits several
buckets of each tree: its own and those behind the cuts it is nearest to.  Inside a bucket scores are
exact; what is lost is only what shares no visited bucket with a query in any tree.

Rows move once per tree, queries once per visited bucket; nothing meets everything.  Equal vectors
are one vector with their k smallest keys, so copies do not fill a bucket, and a bucket is cut into
blocks of bounded size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from codemem.operators import memory as mem
from codemem.session import written

# Rows that the cuts are fitted on, at most; rows of the sample below a last cut, at least.
SAMPLE = 16_384
LEAST = 16
TREES = 4
VISITS = 64
# Vectors in a block of a bucket, and rows of a bucket that the number of cuts aims at.
BLOCK = 20_000
BUCKET = 64


class ProjectionTrees:
    """Cuts of several trees: a direction and a place for every inner node, node n above 2n and 2n + 1."""

    def __init__(self, planes: np.ndarray, places: np.ndarray):
        self.planes, self.places = planes, places
        self.trees, self.depth = len(places), (places.shape[1] + 1).bit_length() - 1

    @classmethod
    def fit(cls, sample: np.ndarray, trees: int, depth: int, seed: int = 1) -> ProjectionTrees:
        rng = np.random.default_rng(seed)
        self = cls(np.zeros((trees, (1 << depth) - 1, sample.shape[1]), np.float32), np.zeros((trees, (1 << depth) - 1), np.float32))
        for tree in range(trees):
            rows = {1: np.arange(len(sample))}
            for node in range(1, 1 << depth):
                own = rows.pop(node)
                plane = np.zeros(sample.shape[1], np.float32)
                if len(own) > 1:
                    a, b = sample[rng.choice(own, 2, replace=False)]
                    plane = (a - b).astype(np.float32)
                if not plane.any():
                    plane = rng.normal(size=sample.shape[1]).astype(np.float32)
                plane /= np.linalg.norm(plane)
                at = sample[own].astype(np.float32) @ plane
                place = np.median(at) if len(own) else 0.0
                self.planes[tree, node - 1], self.places[tree, node - 1] = plane, place
                rows[2 * node], rows[2 * node + 1] = own[at <= place], own[at > place]
        return self

    def _sides(self, vectors: np.ndarray, tree: int) -> np.ndarray:
        return vectors.astype(np.float32) @ self.planes[tree].T - self.places[tree]

    def bucket(self, vectors: np.ndarray, tree: int) -> np.ndarray:
        node, sides = np.ones(len(vectors), np.int64), self._sides(vectors, tree)
        for _ in range(self.depth):
            node = 2 * node + (sides[np.arange(len(vectors)), node - 1] > 0)
        return node - (1 << self.depth)

    def visits(self, vectors: np.ndarray, tree: int, count: int) -> list[list[int]]:
        """The ``count`` buckets of each vector whose farthest cut on the way is nearest."""
        out = []
        for sides in self._sides(vectors, tree):
            queue, found = [(0.0, 1)], []
            while queue and len(found) < count:
                far, node = heapq.heappop(queue)
                if node >= 1 << self.depth:
                    found.append(node - (1 << self.depth))
                    continue
                side = float(sides[node - 1])
                heapq.heappush(queue, (far, 2 * node + (side > 0)))
                heapq.heappush(queue, (max(far, abs(side)), 2 * node + (side <= 0)))
            out.append(found)
        return out


def fit_trees(vectors: DataFrame, trees: int = TREES, bucket: int = BUCKET, sample: int = SAMPLE) -> ProjectionTrees | None:
    """Trees for ``vectors(embedding)``; the sample is its ``sample`` rows with the smallest hashes."""
    counted = vectors.count()
    rows = vectors.select("embedding").orderBy(F.xxhash64("embedding")).limit(sample).toArrow()
    if not rows.num_rows:
        return None
    depth = min(max(0, (counted // bucket).bit_length() - 1), max(0, (rows.num_rows // LEAST).bit_length() - 1))
    return ProjectionTrees.fit(mem._unit(mem._matrix(rows.column("embedding"))), trees, depth)


def recall_similar(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = mem.DEFAULT_K,
    key: Sequence[str] = mem.CHUNK_KEY,
    trees: int = TREES,
    visits: int = VISITS,
    bucket: int = BUCKET,
    block: int = BLOCK,
) -> DataFrame:
    """Top k chunks of every ``queries(query_id, embedding)``, for many queries and many chunks.

    Columns and order are those of ``recall_batch``; the scores are exact, a chunk that shares no visited
    bucket with the query is missed.  More trees or visits find more.
    """
    names = list(key)
    schema = mem._scores_schema(chunks, queries, names)
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    stored = chunks.select(*names, "embedding").filter(F.col("embedding").isNotNull())
    same = Window.partitionBy("__same").orderBy(*names)
    hashed = stored.withColumn("__same", F.xxhash64("embedding"))
    # Of equal vectors the k smallest keys are enough; tasks drop the others before they move.
    distinct = written(hashed.withColumn("__nth", F.row_number().over(same)).filter(F.col("__nth") <= k).drop("__nth", "__same"), "vectors")
    model = fit_trees(distinct, trees, bucket)
    if model is None:
        return mem.best_of_all(chunks.sparkSession.createDataFrame([], schema), k, names)
    shared = chunks.sparkSession.sparkContext.broadcast((model.planes, model.places))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees_ = ProjectionTrees(*shared.value)
        for batch in batches:
            matrix = mem._unit(mem._matrix(batch.column("embedding")))
            for tree in range(trees_.trees) if batch.num_rows else ():
                places = {"__tree": np.full(batch.num_rows, tree, np.int32), "__bucket": trees_.bucket(matrix, tree).astype(np.int32)}
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, places.values())], names=[*batch.schema.names, *places])

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees_ = ProjectionTrees(*shared.value)
        for batch in batches:
            matrix = mem._unit(mem._matrix(batch.column("embedding")))
            for tree in range(trees_.trees) if batch.num_rows else ():
                lists = trees_.visits(matrix, tree, visits)
                rows = np.repeat(np.arange(batch.num_rows), [len(x) for x in lists])
                taken = batch.take(pa.array(rows))
                places = {"__tree": np.full(len(rows), tree, np.int32), "__bucket": np.array(sum(lists, []), np.int32)}
                yield pa.RecordBatch.from_arrays([*taken.columns, *map(pa.array, places.values())], names=[*taken.schema.names, *places])

    types = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    rows = distinct.mapInArrow(placed, types(distinct) + ", __tree int, __bucket int")
    # Trees times buckets: a bounded number of rows.
    sizes = written(rows.groupBy("__tree", "__bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("__blocks")), "buckets")
    rows = rows.join(F.broadcast(sizes), ["__tree", "__bucket"]).withColumn("__block", F.pmod(F.xxhash64(*names), F.col("__blocks")).cast("int")).drop("__blocks")
    asked = queries.select("query_id", "embedding")
    asked = asked.mapInArrow(visiting, types(asked) + ", __tree int, __bucket int")
    asked = asked.join(F.broadcast(sizes.withColumnsRenamed({"__blocks": "__of"})), ["__tree", "__bucket"])
    asked = asked.withColumn("__block", F.explode(F.sequence(F.lit(0), F.col("__of") - 1))).drop("__of")

    def meet(stored: pa.Table, asked: pa.Table) -> pa.Table:
        ids = asked.column("query_id").to_pylist()
        keys = list(zip(*[stored.column(n).to_pylist() for n in names]))
        if not ids or not keys:
            return arrow.empty_table()
        vectors, held = mem._unit(mem._matrix(stored.column("embedding"))), []
        for at in range(0, len(ids), mem.QUERY_BLOCK):
            some = asked.slice(at, mem.QUERY_BLOCK)
            found = mem._merge(mem._top_k_block(keys, vectors, mem._unit(mem._matrix(some.column("embedding"))), k, True), k)
            held += mem._score_rows(found, ids[at : at + mem.QUERY_BLOCK], names)
        return pa.Table.from_pylist(held, schema=arrow)

    place = ("__tree", "__bucket", "__block")
    found = rows.groupBy(*place).cogroup(asked.groupBy(*place)).applyInArrow(meet, schema)
    # A chunk met in several trees has the same score in each.
    return mem.best_of_all(found.dropDuplicates(["query_id", *names]), k, names)
