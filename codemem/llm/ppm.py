"""Language-model scores by prediction by partial matching over bytes, beside a word unigram model.

The model is a trie of byte contexts: for every context of up to ``ORDER`` bytes the counts of the
bytes that follow.  A byte is predicted in its longest context; an unseen one escapes to the
next shorter context with probability d / (t + d), of t occurrences and d different bytes there
(method C).  Symbols that a longer context has already offered are excluded below.  The model is
trained beforehand, on the training documents, so the probability of a byte in its context is the
same everywhere: it is computed once for each kind of context and byte, and a text's score is a sum
of looked-up values.

Counts cover all training texts, and every context counts.  Texts are scored in blocks of bounded size.  A
block asks for each of its distinct words and contexts with a byte once.  The most frequent ones, a
bounded number, are known everywhere; all others are joined with the counts, unseen contexts with
those of one order after the other, and each block gets the answers to its own keys back.  So the
work follows the distinct keys of the blocks at every size, and both scores are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from codemem.llm.common import Words, arrow_type, ascii_lower, rounds, stored

ORDER = 5
# Bytes of text in a block, about; a longer text is a block of its own.
BLOCK_BYTES = 1 << 26
# Contexts with a byte, and words, that are known everywhere, at most.
KNOWN, COMMON = 1 << 18, 1 << 17
# Contexts of so few bytes travel whole.
LOW = 1
# Bytes that no UTF-8 text holds: what stands before a text, and its end.
BEFORE, END = 0xFF, 0xFE
SYMBOLS = 257
# The key of the end token among word hashes.
END_WORD = np.uint64(0x9D3F)
# Distinct keys after which a block's arrays are added up.
GATHER = 1 << 18
WORD, GRAM = 0, 1


def training_rows(modulus: int = 5, held_out: int = 1) -> Column:
    """Whether a document belongs to training, by the checksum of its id; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).cast("binary")) % modulus != held_out


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of the texts, and each text's end, with the ``order`` bytes before it; and their offsets by text."""
    lengths = np.diff(offsets)
    rows = len(lengths)
    out = np.full(len(data) + rows * (order + 1), BEFORE, np.uint8)
    starts = offsets[:-1] + np.arange(rows) * (order + 1) + order
    out[np.arange(len(data)) + np.repeat(starts - offsets[:-1], lengths)] = ascii_lower()[data]
    out[starts + lengths] = END
    wide = out.astype(np.uint64)
    keys = wide[order:].copy()
    for j in range(1, order + 1):
        keys |= wide[order - j : len(wide) - j] << np.uint64(8 * j)
    return keys[out[order:] != BEFORE], np.concatenate([[0], np.cumsum(lengths + 1)])


class _Gather:
    """Counts of keys from many arrays, summed when they grow."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray) -> None:
        unique, n = np.unique(keys, return_counts=True)
        self.parts.append((unique, n))
        self.size += len(unique)
        if self.size > 4 * GATHER:
            self.fold()

    def fold(self) -> None:
        if len(self.parts) > 1:
            keys = np.concatenate([k for k, _ in self.parts])
            n = np.concatenate([c for _, c in self.parts])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.parts = [(keys[first], np.add.reduceat(n, first))]
            self.size = len(first)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.fold()
        out = self.parts[0] if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.parts, self.size = [], 0
        return out


def _blocks(batches, block_bytes: int):
    """Slices of rows ``(doc_id, text, held_out)``, each with the block that it belongs to.

    A block is a part of what one task reads, so the same scan gives the same blocks again.
    """
    block, size = TaskContext.get().partitionId() << 32, 0
    for part, data, offsets in rounds(batches):
        if size and size + len(data) > block_bytes:
            block, size = block + 1, 0
        size += len(data)
        yield block, part, data, offsets


def _distinct(batches, order: int, block_bytes: int):
    """Words and contexts of every block, distinct and counted: ``block, kind, keys, n``."""
    gathers, now = {WORD: _Gather(), GRAM: _Gather()}, None
    for block, part, data, offsets in _blocks(batches, block_bytes):
        if now is not None and block != now:
            yield from ((now, kind, *gather.take()) for kind, gather in gathers.items())
        now = block
        gathers[WORD].add(np.concatenate([Words(data, offsets, lower=True).hash, np.full(part.num_rows, END_WORD, np.uint64)]))
        gathers[GRAM].add(grams(data, offsets, order)[0])
    if now is not None:
        yield from ((now, kind, *gather.take()) for kind, gather in gathers.items())


def count(training: DataFrame, order: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``kind, key, n``: occurrences of every word and of every byte in its context in the training texts."""
    schema = arrow_type("kind int, key long, n long")

    def run(batches):
        for _, kind, keys, n in _distinct(batches, order, block_bytes):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], schema=schema)

    found = training.select("text").mapInArrow(run, "kind int, key long, n long")
    return found.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, those with the largest counts ``n``; of equal ones any, but the same on every run."""
    return counts.orderBy(F.desc("n"), "key").limit(most)


class Lookup:
    """Values of 64-bit keys: one probe of a table, and a search for the few keys that share a place."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        self.keys, self.values = keys, values
        self.shift = np.uint64(64 - max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4)))))
        self.table = np.zeros(1 << (64 - int(self.shift)), np.int32)
        place = self._place(keys)
        self.table[place] = np.arange(len(keys), dtype=np.int32)
        rest = np.flatnonzero(self.table[place] != np.arange(len(keys)))
        rest = rest[np.argsort(keys[rest], kind="stable")]
        self.rest, self.rest_keys = rest, keys[rest]

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = self.table[self._place(keys)].astype(np.int64)
        missed = np.flatnonzero(self.keys[at] != keys)
        if len(missed):
            again = np.full(len(missed), -1, np.int64)
            if len(self.rest):
                spot = np.minimum(np.searchsorted(self.rest_keys, keys[missed]), len(self.rest) - 1)
                again = np.where(self.rest_keys[spot] == keys[missed], self.rest[spot], -1)
            at[missed] = again
        return at


class Trie:
    """Sorted contexts with a byte, for each order, and their counts."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.levels = levels  # by order from 0

    def log10(self, keys: np.ndarray, excluded: np.ndarray | None = None) -> np.ndarray:
        """Log probability of distinct keys, each a byte in its full context.

        ``excluded`` marks, for each key, the symbols that contexts longer than these levels' offered.
        """
        out = np.zeros(len(keys))
        context = keys >> np.uint64(8)
        order = np.argsort(context, kind="stable")
        for first in range(0, len(keys), 4096):
            at = order[first : first + 4096]
            if excluded is None:
                contexts, row = np.unique(context[at], return_inverse=True)
                gone = np.zeros((len(contexts), 256), bool)
            else:
                contexts, row, gone = context[at], np.arange(len(at)), excluded[at]
            out[at] = self._some(contexts, row, (keys[at] & np.uint64(0xFF)).astype(np.int64), gone)
        return out

    def _some(self, contexts: np.ndarray, row: np.ndarray, symbol: np.ndarray, excluded: np.ndarray) -> np.ndarray:
        out = np.zeros(len(row))
        open_ = np.ones(len(row), bool)
        for k in range(len(self.levels) - 1, -1, -1):
            keys, counts = self.levels[k]
            base = (contexts & np.uint64((1 << (8 * k)) - 1)) << np.uint64(8)
            low, high = np.searchsorted(keys, base), np.searchsorted(keys, base + np.uint64(255), side="right")
            n = high - low
            child = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            owner, byte = np.repeat(np.arange(len(contexts)), n), (keys[child] & np.uint64(0xFF)).astype(np.int64)
            offered = ~excluded[owner, byte]
            seen = np.zeros((len(contexts), 256))
            seen[owner[offered], byte[offered]] = counts[child[offered]]
            total, kinds = seen.sum(axis=1)[row], (seen > 0).sum(axis=1)[row]
            hit = seen[row, symbol]
            take = open_ & (hit > 0)
            out[take] += np.log10(hit[take] / (total + kinds)[take])
            open_ &= ~take
            leave = open_ & (kinds > 0)
            out[leave] += np.log10(kinds[leave] / (total + kinds)[leave])
            excluded[owner, byte] = True
        out[open_] -= np.log10(SYMBOLS - excluded.sum(axis=1)[row[open_]])
        return out


# Tables made of a broadcast's value, kept by a worker for its next task; one model's at a time.
_tables: dict[int, tuple] = {}


def _lookups(shared) -> tuple[Lookup, Lookup]:
    value = shared.value  # a worker loads it once; it is held here, so no other one can have its identity
    if id(value) not in _tables:
        _tables.clear()
        words, n, keys, p = value
        _tables[id(value)] = value, Lookup(words.view(np.uint64), n.astype(np.float64)), Lookup(keys.view(np.uint64), p)
    return _tables[id(value)][1:]


def _collect(rows: DataFrame, *columns: str) -> list[np.ndarray]:
    """Columns of a table of bounded size on the driver, in order of the first."""
    found = rows.select(*columns).toArrow()
    arrays = [found.column(c).to_numpy() for c in columns]
    order = np.argsort(arrays[0].view(np.uint64), kind="stable")
    return [a[order] for a in arrays]


class Model:
    """A trained model: written counts of words and of contexts of every order, totals, and broadcasts of bounded size."""

    def __init__(self, training: DataFrame, order: int = ORDER, known: int = KNOWN, common: int = COMMON):
        spark = training.sparkSession
        self.order = order
        counts = stored(count(training, order), "ppm-counts")
        self.words = counts.where(F.col("kind") == WORD).select("key", "n")
        self.tokens, self.kinds = (int(x or 0) for x in self.words.agg(F.sum("n"), F.count("*")).first())
        # Of a context of `order` bytes every shorter one is a part: mask off the bytes in front.
        full = counts.where(F.col("kind") == GRAM).select("key", "n")
        masks = F.array(*[F.struct(F.lit(k).alias("order"), F.col("key").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1)).alias("key")) for k in range(order)])
        shorter = full.select(F.explode(masks).alias("x"), "n").groupBy("x.order", "x.key").agg(F.sum("n").alias("n"))
        self.levels = stored(shorter, "ppm-levels").union(full.select(F.lit(order).alias("order"), "key", "n"))
        # Contexts of at most one byte: no more than 2^16 keys in any language.
        trie = [_collect(self.levels.where(F.col("order") == k), "key", "n") for k in range(min(order, LOW) + 1)]
        self.trie = spark.sparkContext.broadcast([(k.view(np.uint64), n) for k, n in trie])
        # A key of the training texts is predicted in its full context, where nothing is excluded.
        full = full.withColumn("context", F.shiftrightunsigned("key", 8))
        totals = full.groupBy("context").agg((F.sum("n") + F.count("*")).alias("total"))
        self.seen = stored(full.join(totals, "context").select("key", "n", (F.log10("n") - F.log10("total")).alias("p")), "ppm-seen")
        words = _collect(most_frequent(self.words, common), "key", "n")
        self.known = spark.sparkContext.broadcast((*words, *_collect(most_frequent(self.seen, known), "key", "p")))

    def answers(self, keys: DataFrame) -> DataFrame:
        """``kind, key, value`` of distinct ``keys(kind, key)``: a word's count, a byte's log probability."""
        words = keys.where(F.col("kind") == WORD).join(self.words, "key", "left").select("kind", "key", F.coalesce("n", F.lit(0)).cast("double").alias("value"))
        met = stored(keys.where(F.col("kind") == GRAM).join(self.seen.select("key", "p"), "key", "left").select("kind", "key", "p"), "ppm-met")
        unseen = probabilities(met.where("p is null").select("key"), self)
        found = met.where("p is not null").select("kind", "key", F.col("p").alias("value"))
        return words.union(found).union(unseen.select(F.lit(GRAM).alias("kind"), "key", F.col("p").alias("value")))


def probabilities(keys: DataFrame, model: Model) -> DataFrame:
    """``key, p``: log probability of each of the distinct keys, by all counts of the model.

    Keys meet the counts of their context in one order after the other, as long as they escape.
    """
    ddl, trie = "key long, p double, excluded binary", model.trie
    schema = arrow_type(ddl)

    def marks(column):
        return np.unpackbits(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32), axis=1).astype(bool)

    def step(batches):
        for batch in batches:
            rows, p, excluded = batch.num_rows, batch.column(1).to_numpy().copy(), marks(batch.column(2))
            owner = pc.list_parent_indices(batch.column(3)).to_numpy()
            byte, n = (batch.column(i).flatten().to_numpy() for i in (3, 4))
            offered = ~excluded[owner, byte]
            total, kinds = np.bincount(owner[offered], n[offered], rows), np.bincount(owner[offered], minlength=rows)
            symbol = batch.column(0).to_numpy() & 0xFF
            mine = byte == symbol[owner]
            hit = np.zeros(rows)
            hit[owner[mine]] = n[mine]
            found, escaped = hit > 0, (hit == 0) & (kinds > 0)
            p[found] += np.log10(hit[found] / (total + kinds)[found])
            p[escaped] += np.log10(kinds[escaped] / (total + kinds)[escaped])
            excluded[owner, byte] = True
            left = [None if f else x.tobytes() for f, x in zip(found.tolist(), np.packbits(excluded, axis=1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(left, pa.binary())], schema=schema)

    def last(batches):
        low = Trie(trie.value)
        for batch in batches:
            p = batch.column(1).to_numpy() + low.log10(batch.column(0).to_numpy().view(np.uint64), marks(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["key", "p"])

    left, done = keys.select("key", F.lit(0.0).alias("p"), F.lit(bytes(32)).alias("excluded")), []
    for k in range(model.order, LOW, -1):
        left = left.withColumn("context", F.shiftrightunsigned(F.col("key").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1)), 8))
        nodes = model.levels.where(F.col("order") == k).select(F.shiftrightunsigned("key", 8).alias("context"), F.struct(F.col("key").bitwiseAND(F.lit(0xFF)).alias("byte"), "n").alias("next"))
        nodes = nodes.join(left.select("context").distinct(), "context", "left_semi").groupBy("context").agg(F.collect_list("next").alias("next"))
        met = left.join(nodes, "context", "left").select("key", "p", "excluded", F.col("next.byte").alias("byte"), F.col("next.n").alias("n"))
        met = stored(met.mapInArrow(step, ddl), "ppm-escapes")
        done.append(met.where("excluded is null").select("key", "p"))
        left = met.where("excluded is not null")
    out = left.mapInArrow(last, "key long, p double")
    for part in done:
        out = out.union(part)
    return out


TEXTS = "block long, doc_id long, text string, held_out boolean"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
NEEDS = "block long, kind int, key long"


def needs(rows: DataFrame, model: Model, block_bytes: int) -> DataFrame:
    """``block, kind, key``: the keys of every block that are not known everywhere."""
    schema, order, known = arrow_type(NEEDS), model.order, model.known

    def run(batches):
        lookups = dict(zip((WORD, GRAM), _lookups(known)))
        for block, kind, keys, _ in _distinct(batches, order, block_bytes):
            keys = keys[lookups[kind].find(keys) < 0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block)), pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64))], schema=schema)

    return rows.mapInArrow(run, NEEDS)


def score(docs: DataFrame, model: Model, held_out: Column | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Every row gives one row, repeated rows too.  A null or empty text is its end alone; a long one is scored
    whole.  Without training texts every byte has the same probability.  No rows give no rows; further
    columns are not read, so their names cannot clash.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.lit(True) if held_out is None else held_out).alias("held_out"))
    wanted = stored(needs(rows, model, block_bytes), "ppm-needs")
    back = wanted.join(model.answers(wanted.select("kind", "key").distinct()), ["kind", "key"])
    texts_schema, schema, order, known = arrow_type(TEXTS), arrow_type(SCORED), model.order, model.known
    low = np.log10(model.tokens + 0.5 * (model.kinds + 1))

    def place(batches):
        for block, part, _, _ in _blocks(batches, block_bytes):
            columns = [pa.array(np.full(part.num_rows, block)), *part.columns]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, texts_schema)], schema=texts_schema)

    def score_block(texts: pa.Table, answers: pa.Table) -> pa.Table:
        kind, key, value = (answers.column(c).to_numpy() for c in ("kind", "key", "value"))
        words, bytes_ = ((everywhere, Lookup(key[kind == k].view(np.uint64), value[kind == k])) for k, everywhere in zip((WORD, GRAM), _lookups(known)))
        out = []

        def value_of(lookups, keys):
            everywhere, own = lookups
            at = everywhere.find(keys)
            found = everywhere.values[0][at] if len(everywhere.keys) else np.zeros(len(keys))
            rest = np.flatnonzero(at < 0)
            at = own.find(keys[rest])
            if (at < 0).any():
                raise RuntimeError("a text was read in another block than before")
            found[rest] = own.values[0][at] if len(rest) else 0.0
            return found

        for part, data, offsets in rounds(texts.to_batches()):
            found = Words(data, offsets, lower=True)
            count = value_of(words, np.concatenate([found.hash, [END_WORD]]))
            p = np.log10(count + 0.5) - low
            of_row = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[:-1])])[found.first]) + x[-1]
            seen, bounds = grams(data, offsets, order)
            scores = np.add.reduceat(value_of(bytes_, seen), bounds[:-1])
            out.append(pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("held_out"), pa.array(found.count + 1), pa.array(of_row((count > 0).astype(np.int64))),
                pa.array(of_row(p)), pa.array(scores)], schema=schema))
        return pa.Table.from_batches(out, schema=schema)

    scored = rows.mapInArrow(place, TEXTS).groupBy("block").cogroup(back.groupBy("block")).applyInArrow(score_block, SCORED)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def train_and_score(docs: DataFrame, block_bytes: int = BLOCK_BYTES, **how) -> DataFrame:
    """Trains on the documents outside the held-out fifth and scores all, as :func:`score` says."""
    training = training_rows()
    return score(docs, Model(docs.where(training), **how), ~training, block_bytes)
