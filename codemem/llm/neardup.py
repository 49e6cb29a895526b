"""Near-duplicate groups by a join of inverted lists over MinHash signature coordinates.

1. Every document gives its set of distinct word shingles, as 64-bit hashes, and a signature of
   ``coordinates`` minima.  Documents with equal sets share one representative from here on.
2. Representatives are posted under each (coordinate, value) pair.  Two sets of similarity s agree
   in a binomial number of coordinates; the match threshold lies ``DEVIATIONS`` standard deviations
   below its mean at the wanted similarity.  A value that nobody shares matches nothing, so a
   document with fewer shared values than the threshold is skipped.
3. Prefix: values are ordered by the length of their lists; two documents with enough matches meet
   in one of the shortest lists of each, so only those are kept.  Lists tie documents into
   clusters of documents that could be alike.
4. Inside a cluster, documents are dealt to bands of similar set size and to blocks of bounded
   size.  Each pair of blocks of the same or adjacent bands is one group: it counts collisions of
   all signature pairs at once, confirms the pairs above the threshold on the full sets, and returns
   only a spanning forest of the confirmed links, never all pairs.
5. Connected components of these links give the groups.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from codemem.llm.common import Words, components, cut, mix, over_texts, packed, windows

COORDINATES = 64
DEVIATIONS = 6.4
# Documents and shingles in a block, at most about.
BLOCK = 128
BLOCK_SHINGLES = 1 << 18

SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, signature array<int>"


def match_threshold(coordinates: int, similarity: float) -> int:
    """Matches that all but about one in ten billion pairs at ``similarity`` reach."""
    mean = coordinates * similarity
    return max(1, math.floor(mean - DEVIATIONS * math.sqrt(mean * (1 - similarity))))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending inside a row, and their offsets.

    A row of fewer than ``k`` words has its whole sequence as its one shingle; one without words has none.
    """
    words = Words(data, offsets, lower=True)
    rows = len(offsets) - 1
    h, at = windows(words, k)
    row = words.row[at]
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        whole = np.full(len(short), 0x51ED270B, np.uint64)
        for i in range(k - 1):
            has = words.count[short] > i
            whole[has] = mix(whole[has] + words.hash[words.first[short][has] + i] + np.uint64(2 * i + 1))
        h, row = np.concatenate([h, mix(whole + np.uint64(k))]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    bounds = np.searchsorted(row, np.arange(rows + 1))
    parts = [np.unique(h[bounds[i] : bounds[i + 1]]) for i in range(rows)]
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def signatures(hashes: np.ndarray, offsets: np.ndarray, coordinates: int) -> np.ndarray:
    """Minima of ``coordinates`` hash functions for every row that has a shingle; 32 bits each."""
    full = np.flatnonzero(np.diff(offsets) > 0)
    out = np.zeros((len(offsets) - 1, coordinates), np.uint32)
    if len(full):
        low = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        high = (hashes >> np.uint64(32)).astype(np.uint32)
        seeds = mix(np.arange(1, coordinates + 1, dtype=np.uint64))
        starts = offsets[:-1][full]
        for c in range(coordinates):
            x = (low ^ np.uint32(seeds[c] & np.uint64(0xFFFFFFFF))) * np.uint32((int(seeds[c]) >> 32) | 1)
            x = (x ^ (x >> np.uint32(15)) ^ high) * np.uint32(0x2C1B3C6D)
            x ^= x >> np.uint32(13)
            out[full, c] = np.minimum.reduceat(x, starts)
    return out


def sign(docs: DataFrame, k: int = 3, coordinates: int = COORDINATES) -> DataFrame:
    """``doc_id, n_shingles, set_a, set_b, signature`` of every row; two hashes identify a set."""
    def work(part, data, offsets):
        hashes, at = shingle_sets(data, offsets, k)
        n = np.diff(at)
        again = mix(hashes ^ np.uint64(0xA0761D6478BD642F))
        total = np.concatenate([[np.uint64(0)], np.cumsum(hashes, dtype=np.uint64)])
        second = np.concatenate([[np.uint64(0)], np.cumsum(again, dtype=np.uint64)])
        flat = signatures(hashes, at, coordinates)
        ends = pa.array(np.arange(0, flat.size + 1, coordinates, dtype=np.int32))
        return {"doc_id": part.column(0), "n_shingles": n, "set_a": (total[at[1:]] - total[at[:-1]]).view(np.int64),
                "set_b": (second[at[1:]] - second[at[:-1]]).view(np.int64),
                "signature": pa.ListArray.from_arrays(ends, pa.array(flat.ravel().view(np.int32)))}

    return over_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, SIGNED)


def candidates(reps: DataFrame, coordinates: int, threshold: int) -> DataFrame:
    """``doc_id, cluster``: documents that meet in a list kept by the prefix rule, tied into clusters."""
    posted = reps.select("doc_id", F.posexplode("signature").alias("c", "v"))
    posted = posted.select("doc_id", F.shiftleft(F.col("c").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key"))
    lists = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = posted.join(lists, "key").groupBy("doc_id").agg(F.collect_list(F.struct("n", "key")).alias("values"))
    shared = shared.where(F.size("values") >= threshold)
    # Of the values in order, those unshared come first; of n shared ones the first n - threshold + 1 remain.
    prefix = F.slice(F.array_sort("values"), F.lit(1), F.size("values") - threshold + 1)
    kept = cut(shared.select("doc_id", F.explode(prefix).alias("x")).select("doc_id", F.col("x.key").alias("key")))
    heads = kept.groupBy("key").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")).where("n > 1")
    ties = kept.join(heads, "key").where("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    return components(ties).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))


def _block_pairs(rows: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Every document once for each pair of blocks that it has to be in.

    Blocks are counted on ``known(cluster, n_shingles)``, so that the sets themselves are made once.
    """
    step = -math.log(percent / 100)
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(step) + F.lit(1e-9)).cast("long")
    rows = rows.withColumn("band", band)
    sizes = known.withColumn("band", band).groupBy("cluster", "band").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("long").alias("blocks"))
    # Neighbouring bands of the same cluster.
    both = sizes.join(sizes.select("cluster", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above")), ["cluster", "band"], "left")
    both = both.join(sizes.select("cluster", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below")), ["cluster", "band"], "left")
    # Written first: a join of two plain shuffles can be split where a cluster is large.
    rows = rows.join(cut(both), ["cluster", "band"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    mine = F.col("block")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    pair = lambda low, i, high, j: F.struct(low.alias("band"), i.alias("i"), high.alias("band2"), j.alias("j"))
    same = F.transform(upto(F.col("blocks")), lambda j: pair(F.col("band"), F.least(mine, j), F.col("band"), F.greatest(mine, j)))
    none = F.array().cast("array<struct<band:bigint,i:bigint,band2:bigint,j:bigint>>")
    up = F.when(F.col("above").isNull(), none).otherwise(F.transform(upto(F.coalesce("above", F.lit(1))), lambda j: pair(F.col("band"), mine, F.col("band") + 1, j)))
    down = F.when(F.col("below").isNull(), none).otherwise(F.transform(upto(F.coalesce("below", F.lit(1))), lambda j: pair(F.col("band") - 1, j, F.col("band"), mine)))
    return rows.withColumn("pair", F.explode(F.concat(same, up, down))).drop("blocks", "above", "below", "n_shingles")


def linked(signature: np.ndarray, sets: list[np.ndarray], threshold: int, percent: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links among the documents of two blocks: pairs by collisions, confirmed on full sets.

    ``left`` and ``right`` index the documents; a pair already joined by earlier links is skipped.
    """
    parent = np.arange(len(sets))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    sizes = np.array([len(s) for s in sets])
    everything = np.concatenate([sets[j] for j in right])
    owner = np.repeat(np.arange(len(right)), sizes[right])
    order = np.argsort(everything, kind="stable")
    everything, owner = everything[order], owner[order]
    out = []
    for i in left:
        enough = (signature[right] == signature[i]).sum(axis=1) >= threshold
        enough &= right != i
        if not enough.any():
            continue
        low = np.searchsorted(everything, sets[i], side="left")
        high = np.searchsorted(everything, sets[i], side="right")
        n = high - low
        hits = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        common = np.bincount(owner[hits], minlength=len(right))
        good = enough & (100 * common >= percent * (sizes[i] + sizes[right] - common))
        for j in right[good]:
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(i), int(j)))
    return out


def links(pairs: DataFrame, threshold: int, percent: int) -> DataFrame:
    """``a, b``: confirmed links that connect what the rows of each pair of blocks link."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def confirm(group: pa.Table) -> pa.Table:
        ids = group.column("doc_id").to_numpy()
        signature = np.stack(group.column("signature").to_numpy(zero_copy_only=False))
        sets = [np.asarray(s).view(np.uint64) for s in group.column("shingles").to_numpy(zero_copy_only=False)]
        place = group.column("band").to_numpy(), group.column("block").to_numpy()
        first = group.column("pair")[0].as_py()
        left = np.flatnonzero((place[0] == first["band"]) & (place[1] == first["i"]))
        right = np.flatnonzero((place[0] == first["band2"]) & (place[1] == first["j"]))
        found = linked(signature, sets, threshold, percent, left, right) if len(left) and len(right) else []
        return pa.table({"a": pa.array([ids[i] for i, _ in found], pa.int64()), "b": pa.array([ids[j] for _, j in found], pa.int64())}, schema=out)

    return pairs.groupBy("cluster", "pair").applyInArrow(confirm, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, coordinates: int = COORDINATES) -> DataFrame:
    """Per document: ``doc_id, n_shingles, component_id, kept``.

    Documents whose shingle sets reach a similarity of ``percent`` hundredths are linked, through
    any number of others too; ``component_id`` is the smallest id reachable.  A text of fewer than
    ``k`` words is one shingle; a null, empty or blank text has none and is linked with nothing.
    Every row gives one row; rows that share an id share its group.  Rows with a null id take no
    part and keep a null ``component_id`` and ``kept`` true.  No rows give no rows; further
    columns are not read.
    """
    threshold = match_threshold(coordinates, percent / 100)
    signed = cut(sign(docs, k, coordinates))
    of_set = ["set_a", "set_b", "n_shingles"]
    full = signed.where("doc_id is not null and n_shingles > 0")
    reps = full.groupBy(*of_set).agg(F.min("doc_id").alias("rep"))
    rep_rows = full.join(reps, of_set).where("doc_id = rep").select("doc_id", "n_shingles", "signature").dropDuplicates(["doc_id", "n_shingles"])
    clusters = cut(candidates(rep_rows.select("doc_id", "signature"), coordinates, threshold))

    # The full sets of the documents that are in a cluster, made again from their texts.
    def sets(part, data, offsets):
        hashes, at = shingle_sets(data, offsets, k)
        return {"doc_id": part.column(0), "n_shingles": np.diff(at), "cluster": part.column(2), "signature": signed_list(hashes, at),
                "shingles": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64)))}

    def signed_list(hashes, at):
        flat = signatures(hashes, at, coordinates)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, coordinates, dtype=np.int32)), pa.array(flat.ravel().view(np.int32)))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(clusters, "doc_id")
    rows = over_texts(texts, sets, "doc_id long, n_shingles long, cluster long, signature array<int>, shingles array<long>")
    known = clusters.join(rep_rows.select("doc_id", "n_shingles"), "doc_id")
    found = components(links(_block_pairs(rows, known, percent), threshold, percent))
    groups = reps.select(*of_set, "rep").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    groups = groups.select(*of_set, F.coalesce("component", "rep").alias("group"))
    rows = signed.select("doc_id", *of_set).join(groups, of_set, "left")
    group = F.coalesce(F.when(F.col("n_shingles") > 0, F.col("group")), F.col("doc_id"))
    rows = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), group).alias("component_id"))
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, one for each id and text.

    Rows with a null id all stay.
    """
    kept = near_duplicates(docs, **how).where("kept and doc_id is not null").select("doc_id").distinct()
    same = Window.partitionBy("doc_id", "tie").orderBy(F.lit(1))
    rows = packed(docs).join(kept, "doc_id").withColumn("nth", F.row_number().over(same)).where("nth = 1")
    return rows.select("doc.*").union(docs.where("doc_id is null"))
