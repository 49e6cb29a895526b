"""Hashed term vectors and similarity columns."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

DEFAULT_DIM = 384


# Terms whose buckets a task remembers, and texts that are counted at once: both bound what it holds.
_CACHED_TERMS = 100_000
_AT_ONCE = 256


def embedded(batches: Iterator[pa.Array], dim: int = DEFAULT_DIM) -> Iterator[pa.Array]:
    """Vectors of batches of texts; beside a batch and its vectors only ``_AT_ONCE`` rows are held."""
    terms = re.compile(r"\w+").findall
    buckets: dict[str, int] = {}

    def bucket(term: str) -> int:
        at = buckets.get(term)
        if at is None:
            if len(buckets) >= _CACHED_TERMS:
                buckets.clear()
            at = buckets[term] = int.from_bytes(hashlib.md5(term.encode()).digest()[:4], "big") % dim
        return at

    for texts in batches:
        weights = np.zeros((len(texts), dim), np.float32)
        for at in range(0, len(texts), _AT_ONCE):
            part = texts.slice(at, _AT_ONCE)
            counts = np.zeros((len(part), dim))
            for row, body in zip(counts, part):
                found = list(map(bucket, terms((body.as_py() or "").lower())))
                if found:
                    row += np.bincount(found, minlength=dim)
            length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            weights[at : at + len(part)] = np.divide(counts, length, out=counts, where=length > 0)
        offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim)
        yield pa.ListArray.from_arrays(offsets, pa.array(weights.ravel()))


def hash_embedding(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """L2-normalised count vector of a text's hashed terms: ``dim`` floats.

    A term's bucket is the first 32 bits of its MD5 modulo ``dim``; a text without
    terms gets the zero vector.  Counting is done on Arrow batches: a corpus repeats
    its terms, so a cache of their buckets saves nearly all hashing, which columns
    cannot express.  Only the text column visits the worker.
    """

    @F.arrow_udf("array<float>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from embedded(batches, dim)

    return embed(text)


def nonzero(vector: Column) -> Column:
    """Sparse form of a dense vector: array of (bucket, weight)."""
    indexed = F.transform(
        vector, lambda x, i: F.struct(i.cast("bigint").alias("bucket"), x.alias("weight"))
    )
    return F.filter(indexed, lambda e: e["weight"] != 0)


def dot_with(vector: Column, query: Sequence[float]) -> Column:
    """Dot product with a query known when the plan is made: a sum over the query's non-zero entries, in order."""
    entries = [F.struct(F.lit(i).alias("at"), F.lit(float(w)).alias("weight")) for i, w in enumerate(query) if w]
    if not entries:
        return F.lit(0.0)
    return F.aggregate(F.array(*entries), F.lit(0.0), lambda acc, e: acc + F.get(vector, e["at"]).cast("double") * e["weight"])


def norm(vector: Column) -> Column:
    return F.sqrt(
        F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )
