"""Repeated strings by run-length indexes: run-compressed Burrows-Wheeler transforms with sampled run ends.

1. Every window of ``length`` bytes has an anchor, the leftmost smallest hash among its strings of
   ``SEED`` bytes.  Consecutive windows of a text with the same anchor form a piece; a window stands
   in one piece only, and equal windows have equal seeds at their anchors.  So all that a window can
   be equal to is among the pieces of its seed.
2. Seeds that occur once are left out.  Pieces of one seed with equal bytes are one entry with a
   count; what stands twice as a whole repeats as a whole, and of the others one copy is indexed.
3. The pieces of a run of seeds become one index: suffixes are sorted by prefix doubling, the
   transform is cut into runs, and the text positions at both ends of every run are kept.  At a
   run's head the suffix before it is known from the end of the run before; everywhere else the
   matching statistic is one less than that of the position before it.  So the statistics of all
   positions stream from the samples, in text order: how long a string that starts here also starts
   anywhere else.  Windows whose statistic reaches ``length`` repeat.
4. A seed whose different pieces have more than ``SEED_BYTES`` bytes is not one task's: its windows
   are compared by (seed, hash of the window), with counts added up before they move.
5. The windows' bytes are put together per text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codemem.llm.common import CHUNK_BYTES, Rolling, arrow_type, cut, rounds, stored

LENGTH = 200
SEED = 32
# Bytes of pieces in one index, about, and of one seed in an index, at most.
INDEX_BYTES = 1 << 19
SEED_BYTES = 1 << 20
# Stands after every piece; no UTF-8 text holds it.
STOP = 0xFF

# place: where the piece starts in its text, number of its windows, where its anchor is in the first one.
PIECES = "d long, tie long, m long, c long, place long"
ENTRIES = "m long, c long, many boolean, text binary, windows array<long>"
MARKS = "m long, c long, spans array<struct<low:int,high:int>>"


# ---- pieces ---------------------------------------------------------------------------

def anchors(data: np.ndarray, rolling: Rolling, length: int, seed: int) -> np.ndarray:
    """For every window of a buffer of less than 2^20 bytes the place of its leftmost smallest seed."""
    start = np.arange(len(data) - seed + 1)
    # The low bits of a hash make room for the place, so that the smallest one tells where it is.
    key = (rolling.hash(start, start + seed) & ~np.uint64(0xFFFFF)) | start.astype(np.uint64)
    span = length - seed + 1
    blocks = -(-len(key) // span)
    padded = np.full(blocks * span, np.iinfo(np.uint64).max)
    padded[: len(key)] = key
    padded = padded.reshape(blocks, span)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(data) - length + 1
    return (np.minimum(behind[:n], ahead[span - 1 : span - 1 + n]) & np.uint64(0xFFFFF)).astype(np.int64)


def pieces(data: np.ndarray, offsets: np.ndarray, length: int, seed: int) -> dict[str, np.ndarray]:
    """Row, start, windows, anchor, seed's hash and content's hash of the pieces of some texts."""
    rolling = Rolling(data)
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return dict.fromkeys(("row", "start", "windows", "anchor"), none) | dict.fromkeys(("m", "c"), none.view(np.uint64))
    at = anchors(data, rolling, length, seed)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[: len(at)] == row[length - 1 :]
    new = inside.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
    start = np.flatnonzero(new)
    # A piece ends where the next one starts or where windows leave the text.
    count = np.add.reduceat(inside, start) if len(start) else np.zeros(0, np.int64)
    anchor = at[start]
    return {
        "row": row[start], "start": start - offsets[row[start]], "windows": count, "anchor": anchor - start,
        "m": rolling.hash(anchor, anchor + seed), "c": rolling.hash(start, start + count + length - 1),
    }


def buffers(batches, length: int, size: int):
    """Slices of rows ``(d, tie, text, …)`` as bytes: several texts, or a part of a long one with where it starts."""
    for part, data, offsets in rounds(batches):
        if part.num_rows > 1 or len(data) <= size:
            yield part, data, offsets, 0
            continue
        for first in range(0, max(1, len(data) - length + 1), size):
            piece = data[first : first + size + length - 1]
            yield part, piece, np.array([0, len(piece)]), first


def all_pieces(texts: DataFrame, length: int, seed: int, buffer: int = CHUNK_BYTES) -> DataFrame:
    schema = arrow_type(PIECES)

    def run(batches):
        for part, data, offsets, first in buffers(batches, length, buffer):
            p = pieces(data, offsets, length, seed)
            place = (p["start"] + first) << 16 | p["windows"] << 8 | p["anchor"]
            d, tie = (part.column(i).to_numpy(zero_copy_only=False)[p["row"]] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (d, tie, p["m"].view(np.int64), p["c"].view(np.int64), place)], schema=schema)

    return texts.select("d", "tie", "text").mapInArrow(run, PIECES)


def entries(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted pieces ``(d, tie, places[place, m, c, many, hot])``, or the hashes of a hot one's windows."""
    schema = arrow_type(ENTRIES)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data = np.frombuffer(batch.column("text")[i].as_py().encode(), np.uint8)
                listed = batch.column("places")[i].as_py()
                for at in range(0, len(listed), 1000):
                    rows = []
                    for x in listed[at : at + 1000]:
                        start, windows = x["place"] >> 16, x["place"] >> 8 & 0xFF
                        own = data[start : start + windows + length - 1]
                        row = {"m": x["m"], "c": x["c"], "many": x["many"], "text": None, "windows": None}
                        if x["hot"]:
                            first = np.arange(windows)
                            row["windows"] = Rolling(own).hash(first, first + length).view(np.int64)
                        else:
                            row["text"] = own.tobytes()
                        rows.append(row)
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return texts.join(wanted, ["d", "tie"]).select("text", "places").mapInArrow(run, ENTRIES)


# ---- index ----------------------------------------------------------------------------


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, the first one highest."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for i in range(8):
        out |= padded[i : i + len(data)] << np.uint64(56 - 8 * i)
    return out


def suffix_order(data: np.ndarray, words: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffixes in order; ``left`` counts the bytes before the stop of a suffix's piece, and no two stops are equal."""
    n = len(data)
    # What stands behind a stop does not count.
    near = np.flatnonzero(left < 8)
    words = words.copy()
    words[near] &= ~np.uint64(0) << (56 - 8 * left[near]).astype(np.uint64)
    order = np.argsort(words)
    # Stops are ordered by place, so that equal ends of pieces stand in one order at every length.
    short = np.flatnonzero(left[order] < 8)
    order[short] = order[short][np.lexsort((order[short], words[order[short]]))]
    sorted_words = words[order]
    new = np.ones(n, bool)
    new[1:] = (sorted_words[1:] != sorted_words[:-1]) | (left[order[1:]] < 8)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    reach = 8
    while True:
        single = new & np.append(new[1:], True)
        slots = np.flatnonzero(~single)
        if not len(slots):
            return order
        at = order[slots]
        key = rank[at] * n + rank[at + reach]
        within = np.argsort(key)
        at, key = at[within], key[within]
        order[slots] = at
        changed = np.ones(len(slots), bool)
        changed[1:] = key[1:] != key[:-1]
        new[slots] = changed
        rank[at] = np.maximum.accumulate(np.where(changed, slots, 0))
        reach *= 2


class RunIndex:
    """Index of some pieces: runs of the transform, and the suffixes at their ends in text order.

    ``before`` maps the suffix at a run's head to the one sorted before it, ``after`` the suffix at
    a run's end to the one sorted after it; ``run_length`` and ``run_byte`` are the transform.
    """

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(t + b"\xff" for t in texts), np.uint8)
        sizes = np.array([len(t) for t in texts]) + 1
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        n = len(self.data)
        self.left = np.repeat(self.begin[1:] - 1, sizes) - np.arange(n)
        self.words = _words(self.data)
        order = suffix_order(self.data, self.words, self.left)
        byte = self.data[order - 1]
        head = np.ones(n, bool)
        head[1:] = (byte[1:] != byte[:-1]) | (byte[1:] == STOP)
        heads = np.flatnonzero(head)
        ends = np.append(heads[1:], n) - 1
        self.run_byte, self.run_length = byte[heads], ends - heads + 1
        self.before = self._in_text_order(order[heads[1:]], order[heads[1:] - 1], order[0])
        self.after = self._in_text_order(order[ends[:-1]], order[ends[:-1] + 1], order[-1])

    def _in_text_order(self, suffix: np.ndarray, other: np.ndarray, alone: int) -> tuple[np.ndarray, np.ndarray]:
        """Samples by position, with the length of their match; the first or last suffix has none."""
        match = self.common(suffix, other)
        suffix, match = np.append(suffix, alone), np.append(match, 0)
        by = np.argsort(suffix)
        return suffix[by], match[by]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of pairs of suffixes, within their pieces."""
        most = np.minimum(self.left[x], self.left[y])
        length = np.zeros(len(x), np.int64)
        live = np.flatnonzero(most > 0)
        while len(live):
            differ = self.words[x[live] + length[live]] ^ self.words[y[live] + length[live]]
            # Equal bytes at the front, from the place of the highest bit that differs.
            same = np.full(len(live), 8, np.int64)
            some = differ != 0
            high = differ[some] >> np.uint64(32)
            top = np.where(high != 0, high, differ[some] & np.uint64(0xFFFFFFFF)).astype(np.float64)
            same[some] = (np.where(high != 0, 31, 63) - np.floor(np.log2(top)).astype(np.int64)) // 8
            length[live] += same
            live = live[(same == 8) & (length[live] < most[live])]
        return np.minimum(length, most)

    def statistics(self) -> np.ndarray:
        """For every position the longest string from there on that also starts elsewhere."""
        place = np.arange(len(self.data))
        out = np.zeros(len(self.data), np.int64)
        for suffix, match in (self.before, self.after):
            sample = np.searchsorted(suffix, place, side="right") - 1
            known = sample >= 0
            out[known] = np.maximum(out[known], match[sample[known]] - (place[known] - suffix[sample[known]]))
        return out


def _spans(flags: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"low": int(a), "high": int(b)} for a, b in zip(edges[::2], edges[1::2])]


def repeated_windows(texts: list[bytes], many: list[bool], length: int) -> list[list[dict]]:
    """For every piece the ranges of its windows that stand elsewhere too."""
    index = RunIndex(texts)
    enough = index.statistics() >= length
    out = []
    for begin, text, twice in zip(index.begin, texts, many):
        windows = len(text) - length + 1
        out.append([{"low": 0, "high": windows}] if twice else _spans(enough[begin : begin + windows]))
    return out


def indexed(rows: DataFrame, length: int, size: int) -> DataFrame:
    """``m, c, spans`` of the entries: ranges of windows that repeat.  Whole seeds share an index."""
    schema = arrow_type(MARKS)

    def run(batches):
        seeds, contents, texts, many, held = [], [], [], [], 0

        def close():
            found = repeated_windows(texts, many, length)
            keep = [i for i, s in enumerate(found) if s]
            return pa.RecordBatch.from_pylist([{"m": seeds[i], "c": contents[i], "spans": found[i]} for i in keep], schema=schema)

        for batch in batches:
            for m, c, twice, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held >= size and m != seeds[-1]:
                    yield close()
                    seeds, contents, texts, many, held = [], [], [], [], 0
                seeds.append(m)
                contents.append(c)
                texts.append(text)
                many.append(twice)
                held += len(text)
        if texts:
            yield close()

    rows = rows.select("m", "c", "many", "text").repartition("m").sortWithinPartitions("m")
    return rows.mapInArrow(run, MARKS)


# ---- texts ----------------------------------------------------------------------------


def _texts(docs: DataFrame) -> DataFrame:
    """Rows with ``d, tie``, which tell rows with different ids or texts apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tie = F.xxhash64(F.col("doc_id").isNull(), text)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), tie.alias("tie"), text.alias("text"))


def marked(docs: DataFrame, length: int = LENGTH, seed: int = SEED, seed_bytes: int = SEED_BYTES, index_bytes: int = INDEX_BYTES, buffer: int = CHUNK_BYTES) -> DataFrame:
    """``d, tie, spans[low, high]``: byte ranges of repeated windows per text, which may overlap."""
    texts = _texts(docs)
    long_enough = texts.where(F.octet_length("text") >= length)
    found = stored(all_pieces(long_enough, length, seed, buffer), "index-pieces")
    seen = found.groupBy("m").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n")).where("n > 1")
    seen = cut(seen)  # a join of two plain shuffles can be split where a seed is in very many texts
    shared = stored(found.join(seen, "m").select("m", "c", "d", "tie", "place", (F.col("low") == F.col("high")).alias("alone")), "index-shared")
    windows = F.shiftright("place", 8).bitwiseAND(F.lit(0xFF))

    several = shared.where("not alone")
    contents = several.groupBy("m", "c").agg((F.count("*") > 1).alias("many"), *(F.first(x).alias(x) for x in ("d", "tie", "place")))
    contents = cut(contents)
    hot = contents.groupBy("m").agg(F.sum(windows + length - 1).alias("bytes")).where(F.col("bytes") > seed_bytes).select("m", F.lit(True).alias("hot"))
    contents = contents.join(hot, "m", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    wanted = contents.groupBy("d", "tie").agg(F.collect_list(F.struct("place", "m", "c", "many", "hot")).alias("places"))
    held = stored(entries(long_enough.select("d", "tie", "text").dropDuplicates(["d", "tie"]), wanted, length), "index-entries")

    marks = indexed(held.where("text is not null"), length, index_bytes)
    single = held.where("text is null").select("m", "c", "many", F.posexplode("windows").alias("low", "window"))
    twice = single.groupBy("m", "window").agg((F.count("*") > 1).alias("several"), F.max("many").alias("copied")).where("several or copied").select("m", "window")
    hot_marks = single.join(twice, ["m", "window"]).groupBy("m", "c").agg(F.collect_list(F.struct("low", (F.col("low") + 1).alias("high"))).alias("spans"))
    marks = cut(marks.union(hot_marks))

    start = F.shiftright("place", 16)
    inner = several.join(marks, ["m", "c"]).select("d", "tie", start.alias("start"), F.explode("spans").alias("s"))
    inner = inner.select("d", "tie", (F.col("start") + F.col("s.low")).alias("low"), (F.col("start") + F.col("s.high") + length - 1).alias("high"))
    whole = shared.where("alone").select("d", "tie", start.alias("low"), (start + windows + length - 1).alias("high"))
    # Equal rows mark equal places: a set, made in every task first.
    return cut(inner.union(whole).groupBy("d", "tie").agg(F.collect_set(F.struct("low", "high")).alias("spans")))


KEPT = "doc_id long, n_bytes long, spans array<struct<low:bigint,high:bigint>>, kept binary"


def without_repeats(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """Per row ``doc_id, n_bytes, spans, kept``: maximal byte ranges that repeat, and the bytes that are left.

    A byte is in a range if a string of ``length`` bytes that covers it also starts anywhere else, in
    the same text or another one; strings are judged on the texts as given and never cross them.  A
    null text is empty; empty and shorter texts keep all.  Repeated rows, and rows that share an id,
    are texts each; rows without an id are handled like the others.  A long text is cut into buffers
    whose windows overlap.  No rows give no rows.  Further columns are not read.
    """
    schema = arrow_type(KEPT)

    def run(batches):
        for part, data, offsets in rounds(batches):
            spans, kept = [], []
            for i, listed in enumerate(part.column(2).to_pylist()):
                own = data[offsets[i] : offsets[i + 1]]
                if listed:
                    edges = np.array(sorted((s["low"], s["high"]) for s in listed))
                    reach = np.maximum.accumulate(edges[:, 1])
                    first = np.flatnonzero(np.append(True, edges[1:, 0] > reach[:-1]))
                    low, high = edges[first, 0], reach[np.append(first[1:], len(edges)) - 1]
                    spans.append([{"low": int(a), "high": int(b)} for a, b in zip(low, high)])
                    stays = np.zeros(len(own) + 1, np.int32)
                    stays[low] += 1
                    stays[high] -= 1
                    kept.append(own[np.cumsum(stays[:-1]) == 0].tobytes())
                else:
                    spans.append([])
                    kept.append(own.tobytes())
            arrays = [part.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(spans, schema.field("spans").type), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    rows = _texts(docs).join(marked(docs, length, **how), ["d", "tie"], "left")
    return rows.select("doc_id", "text", "spans").mapInArrow(run, KEPT)


def digest(kept: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["high"] - s["low"])
    return kept.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
