"""Chunking, embedding and recall."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from codemem.functions import text as tx, vectors as vx
from codemem.operators.joins import sized_join
from codemem.operators.symbols import rows_of
from codemem.session import written

DEFAULT_K = 3
DEFAULT_CHUNK_TOKENS = 256
# Characters of one word in a chunk: encoded and minified files hold words of any length.
WORD_CHARS = 1000

# The reply that carries no memory, and the two answers when nothing is left.
EMPTY_REPLY = "got it."
NO_RESULTS = "No relevant memories found in codebase index."
NO_TEXTS = "No relevant memories found."
DECISION_LEAD = "Architectural Decision Record:\n"
DECISION_DATASET = "adr_decision_"

CHUNK_KEY = ("dataset", "doc_id", "chunk_no")


def _runs(text: Column, max_tokens: int) -> Column:
    """Runs of words with the white space around them; a longer word counts as several.

    Possessive quantifiers keep the matcher iterative, whatever the length of a text.
    """
    found = lambda ws: F.regexp_extract_all(
        text, F.lit(rf"(?:[{ws}]*+[^{ws}]{{1,{WORD_CHARS}}}+){{1,{max_tokens}}}+[{ws}]*+"), F.lit(0)
    )
    return tx.by_ws(text, found(tx.ASCII_WS), found(tx.WS_CLASS))


# Queries that travel with one pass over the vectors, about.
QUERY_BLOCK = 4096
SCORES_AT_ONCE = 1_000_000
# Vectors that a task scores at once.
ROWS_AT_ONCE = 1024


# ---- documents to chunks --------------------------------------------------------------


def chunk_documents(docs: DataFrame, max_tokens: int = DEFAULT_CHUNK_TOKENS, text: str = "text") -> DataFrame:
    """Split each text into runs of at most ``max_tokens`` words.

    Words keep the white space after them, so a document's chunks joined in order
    are its text.  Splitting happens inside the row and moves no data.
    """
    keep = [c for c in docs.columns if c != text]
    chunks = rows_of(docs.select(*keep, _runs(F.col(text), max_tokens).alias("__runs")), "__runs", text, "chunk_no")
    return chunks.select(*keep, F.col("chunk_no").cast("bigint").alias("chunk_no"), text)


Embedder = Callable[[DataFrame], DataFrame]


def hash_embedder(dim: int = vx.DEFAULT_DIM) -> Embedder:
    return lambda chunks: chunks.withColumn("embedding", vx.hash_embedding(F.col("text"), dim))


def model_embedder(encode: Callable[[list[str]], np.ndarray], load: Callable | None = None) -> Embedder:
    """Plug point for a real model: ``encode`` gets a batch of texts and returns a matrix.

    The model is loaded once per task; batches follow the session's Arrow batch size.
    """

    def embed(chunks: DataFrame) -> DataFrame:
        @F.pandas_udf("array<float>")
        def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            if load is not None:
                load()
            for texts in batches:
                matrix = np.asarray(encode(texts.tolist()), dtype=np.float32)
                yield pd.Series(list(matrix))

        return chunks.withColumn("embedding", vectors("text"))

    return embed


def ingest(docs: DataFrame, embedder: Embedder | None = None, max_tokens: int = DEFAULT_CHUNK_TOKENS) -> DataFrame:
    """Documents to embedded chunks; secrets are removed first, whatever the kind."""
    safe = docs.withColumn("text", tx.redact(F.col("text")))
    return (embedder or hash_embedder())(chunk_documents(safe, max_tokens))


# ---- recall ---------------------------------------------------------------------------


def query_vector(spark, text: str, embedder: Embedder | None = None) -> list[float]:
    """Vector of one query, made by the same expression as the stored ones."""
    one = spark.range(1).select(F.lit(text).alias("text"))
    return list((embedder or hash_embedder())(one).first()["embedding"])


def cosine(vector: Column, query: Sequence[float], unit_vectors: bool = True) -> Column:
    length = float(np.linalg.norm(np.asarray(query, dtype=np.float64)))
    if length == 0.0:
        return F.lit(0.0)
    score = vx.dot_with(vector, query) / F.lit(length)
    if not unit_vectors:
        own = vx.norm(vector)
        score = F.when(own > 0, score / own).otherwise(F.lit(0.0))
    return F.round(score, 6)


def scored(
    chunks: DataFrame,
    query: Sequence[float],
    datasets: Sequence[str] | None = None,
    unit_vectors: bool = True,
) -> DataFrame:
    """Chunks with their similarity; naming datasets prunes partitions of the store."""
    scope = chunks if datasets is None else chunks.filter(F.col("dataset").isin(*datasets))
    rest = [c for c in scope.columns if c != "embedding"]
    return scope.select(*rest, cosine(F.col("embedding"), query, unit_vectors).alias("score"))


def ranked(top: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Number the rows of a k-row result."""
    keyed = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.struct(*top.columns).alias("row"))
    packed = top.agg(F.array_sort(F.collect_list(keyed)).alias("rows"))
    return packed.select(F.posexplode("rows").alias("pos", "r")).select(
        (F.col("pos") + 1).cast("bigint").alias("rank"), "r.row.*"
    )


def recall(
    chunks: DataFrame,
    query: Sequence[float],
    k: int = DEFAULT_K,
    datasets: Sequence[str] | None = None,
    unit_vectors: bool = True,
) -> DataFrame:
    """The ``k`` most similar chunks: each task keeps its own k, then the tasks' rows meet."""
    best = scored(chunks, query, datasets, unit_vectors)
    top = best.orderBy(F.desc("score"), *CHUNK_KEY).limit(k)
    return ranked(top, [-F.col("score"), *map(F.col, CHUNK_KEY)])


def recall_per_dataset(
    chunks: DataFrame, query: Sequence[float], k: int = DEFAULT_K, datasets: Sequence[str] | None = None
) -> DataFrame:
    """Top k of every dataset; tasks drop all but k rows per dataset before the shuffle."""
    order = Window.partitionBy("dataset").orderBy(F.desc("score"), "doc_id", "chunk_no")
    best = scored(chunks, query, datasets)
    return best.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)


# ---- many queries ---------------------------------------------------------------------


def _best_of(query_at: np.ndarray, scores: np.ndarray, row_at: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best entries per query; ties go to the smaller row number."""
    order = np.lexsort((row_at, -scores, query_at))
    ordered = query_at[order]
    starts = np.r_[True, ordered[1:] != ordered[:-1]]
    first = np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - first < k]


def _unit(matrix: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(flat):
        return np.zeros((0, 0))
    values = np.asarray(flat.flatten(), dtype=np.float64)
    return values.reshape(len(flat), -1)


def _top_k_block(keys: list[tuple], vectors: np.ndarray, queries: np.ndarray, k: int, unit: bool) -> list[tuple]:
    """(query position, score, key) of the best k of a block for every query."""
    by_key = sorted(range(len(keys)), key=keys.__getitem__)
    vectors = vectors[by_key] if unit else _unit(vectors[by_key])
    step = max(1, SCORES_AT_ONCE // max(1, len(queries)))
    held: list[tuple] = []
    for at in range(0, len(by_key), step):
        scores = np.round(queries @ vectors[at : at + step].T, 6) + 0.0
        if scores.shape[1] > k:
            bar = np.partition(scores, -k, axis=1)[:, -k][:, None]
            query_at, row_at = np.nonzero(scores >= bar)
        else:
            query_at, row_at = (part.ravel() for part in np.indices(scores.shape))
        values = scores[query_at, row_at]
        for p in _best_of(query_at, values, row_at, k):
            held.append((int(query_at[p]), float(values[p]), keys[by_key[at + row_at[p]]]))
    return held


def _merge(held: list[tuple], k: int) -> list[tuple]:
    held.sort(key=lambda e: (e[0], -e[1], e[2]))
    kept, seen, count = [], None, 0
    for entry in held:
        count = count + 1 if entry[0] == seen else 1
        seen = entry[0]
        if count <= k:
            kept.append(entry)
    return kept


def _scores_schema(chunks: DataFrame, queries: DataFrame, names: Sequence[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in chunks.schema}
    return ", ".join([f"query_id {queries.schema['query_id'].dataType.simpleString()}", *[f"{n} {types[n]}" for n in names], "score double"])


def _score_rows(held: list[tuple], ids: list, names: Sequence[str]) -> list[dict]:
    return [{"query_id": ids[q], **dict(zip(names, at)), "score": s} for q, s, at in held]


def best_of_all(scores: DataFrame, k: int, names: Sequence[str]) -> DataFrame:
    """Top k of every query; tasks drop all but k rows per query before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *names)
    return scores.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)


def recall_batch(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_K,
    key: Sequence[str] = CHUNK_KEY,
    unit_vectors: bool = True,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """Top k chunks of every query, exact, scored as matrix products.

    ``queries(query_id, embedding)`` are dealt to blocks of about ``query_block`` rows.  A block
    travels with the tasks of one pass over the vectors, in which every task keeps k rows per
    query.  Vectors stay where they are.  ``unit_vectors`` says that the stored vectors
    already have length 1.  For very many queries see ``nearest.recall_similar``.
    """
    names = list(key)
    schema = _scores_schema(chunks, queries, names)
    vectors = chunks.select(*names, "embedding")
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    asked = queries.select("query_id", "embedding")
    blocks = max(1, -(-asked.count() // query_block))

    def scored_by(block: int) -> DataFrame:
        local = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow()
        ids = local.column("query_id").to_pylist()
        matrix = _unit(_matrix(local.column("embedding")))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            for part in (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE)):
                keys = list(zip(*[part.column(n).to_pylist() for n in names]))
                if keys and ids:
                    held = _merge(held + _top_k_block(keys, _matrix(part.column("embedding")), matrix, k, unit_vectors), k)
            if held:
                yield pa.RecordBatch.from_pylist(_score_rows(held, ids, names), schema=arrow)

        return vectors.mapInArrow(scan, schema)

    return best_of_all(reduce(DataFrame.unionByName, map(scored_by, range(blocks))), k, names)


# ---- results --------------------------------------------------------------------------


def dedup_normalized(texts: DataFrame, rank: str = "rank", text: str = "text") -> DataFrame:
    """First of each group of near-literal copies, over a table of any size.

    ``rank`` is unique.  Only hashes and ranks are aggregated, so a group holding
    a third of all rows is reduced inside each task.
    """
    # Normalised once, and written: both the groups and the ranks that go start from it.
    hashed = written(texts.select(rank, F.sha2(tx.normalize_ws(F.col(text)), 256).alias("k")), "normalised")
    void = F.col("k").isin(*[hashlib.sha256(t.encode()).hexdigest() for t in ("", EMPTY_REPLY)])
    groups = hashed.groupBy("k").agg(F.min(F.when(~void, F.col(rank))).alias("first"), F.count("*").alias("n"))
    groups = groups.filter(F.col("first").isNull() | (F.col("n") > 1)).select("k", "first")
    # Those that go: copies and void texts.  They are usually few, and texts stay where they are.
    lost = sized_join(hashed, groups, ["k"], "inner").filter(F.col("first").isNull() | (F.col(rank) != F.col("first")))
    return sized_join(texts, lost.select(rank), [rank], "left_anti")


def answer_text(results: DataFrame) -> DataFrame:
    """One answer from a k-row recall: distinct texts in rank order, a blank line between."""
    entry = F.struct("rank", tx.normalize_ws(F.col("text")).alias("key"), "text")
    packed = results.agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    told = F.filter("rows", lambda r: ~r["key"].isin("", EMPTY_REPLY))
    packed = packed.select("rows", told.alias("told"))
    is_first = lambda r, i: ~F.exists(F.slice("told", F.lit(1), i), lambda p: p["key"] == r["key"])
    texts = F.transform(F.filter("told", is_first), lambda r: r["text"])
    return packed.select(
        F.when(F.size("rows") == 0, NO_RESULTS)
        .when(F.size("told") == 0, NO_TEXTS)
        .otherwise(F.array_join(texts, "\n\n"))
        .alias("answer")
    )


def with_graph(results: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Neighbours of the files that ``results(rank, repo, path)`` name: one row per result and symbol."""
    # Both sides are bounded by the hits: they are written, so that the recall behind them runs once.
    hits = written(results.select("rank", "repo", F.col("path").alias("file")), "hits")
    near = sized_join(edges, hits, ["repo", "file"], "inner").select("rank", "repo", "file", F.col("dst").alias("id"))
    # The hit files bound the node side as well: it is filtered before it is joined.
    known = sized_join(nodes, hits.select("repo", "file").distinct(), ["repo", "file"], "left_semi")
    return sized_join(near, known.select("repo", "file", "id", "grp", "label"), ["repo", "file", "id"], "inner")


# ---- decisions, datasets, status ------------------------------------------------------


def decision_docs(decisions: DataFrame) -> DataFrame:
    """Memory documents of logged decisions ``(id, ts, text)``; blank ones are refused."""
    epoch = F.unix_timestamp("ts").cast("string")
    return decisions.filter(F.col("text") != "").select(
        F.concat(F.lit(DECISION_DATASET), epoch).alias("dataset"),
        F.concat(F.lit("decision:"), F.col("id").cast("string")).alias("doc_id"),
        F.lit("decision").alias("kind"),
        F.lit(None).cast("string").alias("path"),
        F.concat(F.lit(DECISION_LEAD), F.col("text")).alias("text"),
    )


def recent_decisions(decisions: DataFrame, n: int) -> DataFrame:
    return decisions.orderBy(F.desc("ts"), F.desc("id")).limit(n)


def list_datasets(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("dataset") != "").select("dataset").distinct()


def memory_status(docs: DataFrame, at: str = "ingested_at") -> DataFrame:
    return docs.groupBy("dataset", "kind").agg(
        F.count("*").alias("n_docs"), F.max(at).alias("last_ingested_at")
    )


# ---- forgetting -----------------------------------------------------------------------


def forget_datasets(docs: DataFrame, names: Sequence[str]) -> DataFrame:
    return docs.filter(~F.coalesce(F.col("dataset").isin(*names), F.lit(False)))


def forget_files(docs: DataFrame, paths: DataFrame, path: str = "path") -> DataFrame:
    """Drop documents whose path is listed in ``paths(path)``."""
    gone = paths.select(F.col(path)).distinct()
    return sized_join(docs, gone, [path], "left_anti")


def mentions_file(path: str, text: Column, name: Column) -> Column:
    """Loose match: the text holds the path line, or the name holds the path."""
    return F.coalesce(F.contains(text, F.lit(f"File Path: {path}")), F.lit(False)) | F.coalesce(
        F.contains(name, F.lit(path)), F.lit(False)
    )


def forget_file_substring(docs: DataFrame, path: str, legacy: str | None = None) -> DataFrame:
    """Drop every document that mentions the path anywhere, and the path's own old dataset."""
    old_name = legacy if legacy is not None else path.translate(str.maketrans("/\\. ", "____"))
    return docs.filter(~mentions_file(path, F.col("text"), F.col("path")) & (F.col("dataset") != old_name))


def forget_tag(docs: DataFrame, tags: Sequence[str], column: str = "tag") -> DataFrame:
    return docs.filter(~F.coalesce(F.col(column).isin(*tags), F.lit(False)))
