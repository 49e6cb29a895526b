"""An index of stored vectors: chunks in Parquet partitions by their nearest centre, searched exactly.

Centres are fitted on a bounded sample.  Every chunk is stored in the cell of its nearest centre with its
distance from it; a small table holds the cells' centres and the range of those distances.  The
triangle inequality says how near a chunk can be to a query from the query's distance to the centre,
so a search reads the cells that come into question, nearest first, and of those only the rows at
a fitting distance; both are predicates of the scan.  Which centres were fitted decides
how much is read and never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType
from pyspark.sql.pandas.types import to_arrow_schema

from codemem.operators import memory as mem
from codemem.session import written

# Rows that centres are fitted on, at most; rows of the sample for one centre; centres, at most.
SAMPLE = 16_384
PER_CENTRE = 32
CENTRES = 512
ROUNDS = 8
# What rounded scores and single-precision vectors may be off.
SLACK = 4e-6
CELLS = "cell INT, centre ARRAY<DOUBLE>, n BIGINT, least DOUBLE, most DOUBLE"
# Vectors that a task compares with the centres at once.
AT_ONCE = 1024
# Queries of a batch that are asked together.
TOGETHER = 64
# The cell goes last: it decides no tie.
KEY = (*mem.CHUNK_KEY, "cell")


def fit_centres(sample: np.ndarray, count: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Centres of a bounded sample, by alternating assignment and means; empty ones stay."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(sample, centres)[0]
        sizes = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        some = sizes > 0
        centres[some] = sums[some] / sizes[some, None]
    return centres


def nearest(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each vector and the distance to it."""
    squares = (centres * centres).sum(axis=1) - 2 * (vectors @ centres.T)
    cell = squares.argmin(axis=1)
    return cell, np.linalg.norm(vectors - centres[cell], axis=1)


class VectorIndex:
    """Tables ``chunks`` (by ``cell``, with ``away``) and ``cells`` below a folder.  Vectors have length 1 or 0."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ---- writing ----------------------------------------------------------------------

    def build(self, chunks: DataFrame, centres: int | None = None) -> VectorIndex:
        """Index ``chunks(dataset, doc_id, chunk_no, …, embedding)``; all rows, in one pass after the fit.

        Give it a table, not a plan that embeds: the fit and the pass both read it.
        """
        rows = chunks.select("embedding").orderBy(F.xxhash64("embedding")).limit(SAMPLE).toArrow()
        sample = mem._matrix(rows.column("embedding")) if rows.num_rows else np.zeros((1, 1))
        model = fit_centres(sample, centres or min(CENTRES, max(1, len(sample) // PER_CENTRE)))
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
        schema = StructType.fromDDL(f"{ddl}, away double, cell int")
        arrow = to_arrow_schema(schema)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, AT_ONCE):
                    part = batch.slice(at, AT_ONCE)
                    cell, away = nearest(mem._matrix(part.column("embedding")), model)
                    columns = [c.cast(f.type) for c, f in zip(part.columns, arrow)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(away), pa.array(cell.astype(np.int32))], schema=arrow)

        placed = chunks.mapInArrow(place, schema)
        # A cell with very many rows becomes several files; sorted distances let the scan skip row groups.
        placed = placed.hint("rebalance", "cell").sortWithinPartitions("cell", "away")
        placed.write.mode("overwrite").option("compression", "zstd").partitionBy("cell").parquet(f"{self.root}/chunks")
        columns = self.spark.createDataFrame([(f"{ddl}, away double, cell int",)], "columns STRING")
        columns.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/columns")
        cells = self._chunks().groupBy("cell").agg(F.count("*").alias("n"), F.min("away").alias("least"), F.max("away").alias("most"))
        held = {r["cell"]: r for r in cells.collect()}  # one row for each of at most CENTRES cells
        table = [(int(c), model[c].tolist(), r["n"], r["least"], r["most"]) for c, r in held.items()]
        made = self.spark.createDataFrame(table, CELLS)
        made.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/cells")
        return self

    def _chunks(self) -> DataFrame:
        columns = self.spark.read.schema("columns STRING").parquet(f"{self.root}/columns").first()[0]
        return self.spark.read.schema(columns).parquet(f"{self.root}/chunks")

    # ---- searching --------------------------------------------------------------------

    def _cells(self) -> tuple[np.ndarray, ...]:
        rows = self.spark.read.schema(CELLS).parquet(f"{self.root}/cells").orderBy("cell").collect()
        return tuple(np.array([r[name] for r in rows]) for name in ("cell", "centre", "n", "least", "most"))

    def candidates(self, queries: np.ndarray, scores: Sequence[float]) -> DataFrame:
        """Chunks whose score with one of the queries can reach that query's given score."""
        cells, centres, _, least, most = self._cells()
        wanted: dict[int, list[tuple[float, float]]] = {}
        for query, score in zip(queries, scores):
            # |q - x|² = |q|² + |x|² - 2 q·x, with lengths of at most 1.
            reach = np.sqrt(max(0.0, 2 - 2 * (score - SLACK)))
            away = np.linalg.norm(centres - query, axis=1) if len(cells) else np.zeros(0)
            low, high = np.maximum(away - reach - SLACK, least), np.minimum(away + reach + SLACK, most)
            for at in np.flatnonzero(low <= high):
                wanted.setdefault(int(cells[at]), []).append((float(low[at]), float(high[at])))
        rows = self._chunks()
        if not wanted:
            return rows.limit(0)
        bounds = self.spark.createDataFrame(
            [(c, min(a for a, _ in r), max(b for _, b in r)) for c, r in wanted.items()], "cell INT, from_ DOUBLE, to_ DOUBLE"
        )
        # The cells are named in the plan, so that other partitions are not listed; the ranges differ by cell.
        inside = rows.filter(F.col("cell").isin(*sorted(wanted)))
        least_of_all, most_of_all = min(a for r in wanted.values() for a, _ in r), max(b for r in wanted.values() for _, b in r)
        inside = inside.filter(F.col("away").between(least_of_all, most_of_all))
        return inside.join(F.broadcast(bounds), "cell").filter(F.col("away").between(F.col("from_"), F.col("to_"))).drop("from_", "to_")

    def _nearest_cells(self, queries: np.ndarray, k: int) -> list[int]:
        """For every query the nearest cells that hold ``k`` chunks together."""
        cells, centres, n, _, _ = self._cells()
        out: set[int] = set()
        for query in queries if len(cells) else ():
            order = np.argsort(np.linalg.norm(centres - query, axis=1))
            enough = int(np.searchsorted(np.cumsum(n[order]), k)) + 1
            out |= set(cells[order[:enough]].tolist())
        return sorted(out)

    def _ask(self, asked: pa.Table, k: int) -> DataFrame:
        """Keys and scores of the top k of up to ``TOGETHER`` queries."""
        queries = mem._unit(mem._matrix(asked.column("embedding")))
        local = self.spark.createDataFrame(asked)
        first = self._chunks().filter(F.col("cell").isin(*self._nearest_cells(queries, k)))
        lowest = mem.recall_batch(first, local, k, KEY).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low"))
        floors = {r["query_id"]: (r["n"], r["low"]) for r in lowest.collect()}
        # Without k scores, and for a query without terms, every chunk may be among the best.
        known = [floors.get(q, (0, 0.0)) for q in asked.column("query_id").to_pylist()]
        scores = [low if n == k and query.any() else -1.0 for (n, low), query in zip(known, queries)]
        return mem.recall_batch(self.candidates(queries, scores), local, k, KEY)

    def recall_batch(self, queries: DataFrame, k: int = mem.DEFAULT_K) -> DataFrame:
        """Top k of every ``queries(query_id, embedding)`` with all stored columns; equal to a full scan.

        Queries are asked ``TOGETHER`` at a time, a block being two reads of the cells in question.
        """
        asked = queries.select("query_id", "embedding")
        blocks = max(1, -(-asked.count() // TOGETHER))
        found = None
        for block in range(blocks):
            local = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow()
            if local.num_rows:
                best = self._ask(local, k)
                found = best if found is None else found.unionByName(best)
        if found is None:
            return self._chunks().drop("embedding", "away", "cell").limit(0)
        found = written(found, "indexed")
        cells = [r["cell"] for r in found.select("cell").distinct().collect()]
        texts = self._chunks().drop("embedding", "away").filter(F.col("cell").isin(*cells))
        return texts.join(found, list(KEY)).drop("cell")

    def recall(self, query: Sequence[float], k: int = mem.DEFAULT_K) -> DataFrame:
        one = self.spark.createDataFrame([(0, [float(x) for x in query])], "query_id INT, embedding ARRAY<FLOAT>")
        return self.recall_batch(one, k).drop("query_id")
