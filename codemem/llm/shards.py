"""Training-order materialisation: token sequences at permuted global slots, in fixed-stride binary shards.

1. Texts are encoded and packed, in the order in which a task reads them, into sequences of a fixed
   number of token ids, each text followed by the end id; a task's last sequence is filled up with it.
   The sequences are written once, so everything after reads the same ones.
2. A sequence's global number is its place in its task behind all earlier tasks.
3. A keyed Feistel network on the next even number of bits permutes the numbers; values outside the
   range are sent through again until they fall inside (cycle-walking).  The result is the
   sequence's slot in training order, without any list of slots.
4. Slots are dealt by ranges of whole shards.  Each shard is a file of little-endian 16-bit ids, so that
   slot ``s`` is found at byte ``(s % shard) * stride`` of file ``s // shard``.  A file is written under
   another name and renamed, with the same bytes on every try.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from codemem.llm.bpe import PATTERN, ForcedBpe, Vocabulary
from codemem.llm.common import arrow_type, ensure_checkpoints, mix, rounds, stored

SEQUENCE = 1024
SHARD = 512
ROUNDS = 6
KEY = 0x5EED
# Level at which pieces of shards are pressed; the written sequences one more.
PRESS = 4


class Compiled:
    """The vocabulary in a compiled encoder; strings of special tokens are ordinary text, so the end id stands for ends alone."""

    def __init__(self, text: str):
        codec = ForcedBpe(text)
        self.end_id = next(iter(codec.special.values()))
        ranks = {token: i for i, token in codec.bytes_of.items() if i not in codec.special.values()}
        self.library = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        return self.library.encode_to_numpy(text, disallowed_special=()).astype("<u2")


@lru_cache(maxsize=1)
def _codec(text: str) -> Compiled:
    return Compiled(text)


def feistel(index: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """Slots of the numbers ``index`` below ``n``: a bijection of 0..n-1."""
    half = np.uint64(max(1, (max(1, int(n) - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = mix(np.uint64(key) + np.arange(rounds, dtype=np.uint64))
    out = index.astype(np.uint64).copy()
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> half, out[walk] & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        out[walk] = left << half | right
        walk = walk[out[walk] >= np.uint64(n)]
    return out.astype(np.int64)


def unfeistel(slot: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """The numbers that :func:`feistel` sends to ``slot``."""
    half = np.uint64(max(1, (max(1, int(n) - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = mix(np.uint64(key) + np.arange(rounds, dtype=np.uint64))
    out = slot.astype(np.uint64).copy()
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> half, out[walk] & mask
        for k in keys[::-1]:
            left, right = right ^ (mix(left + k) & mask), left
        out[walk] = left << half | right
        walk = walk[out[walk] >= np.uint64(n)]
    return out.astype(np.int64)


PACKED = "part int, nth long, ids binary, doc_ids array<long>"


def pack(docs: DataFrame, vocabulary: Vocabulary, length: int = SEQUENCE) -> DataFrame:
    """``part, nth, ids, doc_ids``: sequences of ``length`` ids and the documents in each.

    A null or empty text is its end id alone.
    """
    schema = arrow_type(PACKED)

    def run(batches):
        codec, part, nth = _codec(vocabulary.text.value), TaskContext.get().partitionId(), 0
        end = np.array([codec.end_id], "<u2")
        held: list[np.ndarray] = []
        size = 0
        owners: list[tuple[int, int]] = []  # first id of a document in what is left, and the document

        def cut(count):
            nonlocal held, size, owners, nth
            ids = np.concatenate(held)
            bounds = [(a, owners[i + 1][0] if i + 1 < len(owners) else len(ids), d) for i, (a, d) in enumerate(owners)]
            lists: list[list] = [[] for _ in range(count)]
            for a, b, d in bounds:
                for k in range(a // length, min(count, -(-b // length))):
                    lists[k].append(d)
            rows = [ids[k * length : (k + 1) * length].tobytes() for k in range(count)]
            out = pa.RecordBatch.from_arrays([pa.array(np.full(count, part, np.int32)), pa.array(nth + np.arange(count)), pa.array(rows, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], schema=schema)
            nth += count
            held, size = [ids[count * length :]], len(ids) - count * length
            owners = [(max(0, a - count * length), d) for a, b, d in bounds if b > count * length]
            return out

        for batch, _, _ in rounds(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                owners.append((size, doc))
                held += [codec.encode(text or ""), end]
                size += len(held[-2]) + 1
            if size >= length:
                yield cut(size // length)
        if size:
            held.append(np.repeat(end, length - size))
            yield cut(1)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PACKED)


def number(packed: DataFrame, key: int = KEY) -> DataFrame:
    """``seq, slot, ids, doc_ids``: global numbers and their places in training order."""
    counts = {r["part"]: r["n"] for r in packed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row for each task of the scan
    first, total = {}, 0
    for part in sorted(counts):
        first[part], total = total, total + counts[part]
    schema = arrow_type("seq long, slot long, ids binary, doc_ids array<long>")

    def run(batches):
        for batch in batches:
            seq = np.array([first[p] for p in batch.column(0).to_pylist()], np.int64) + batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(seq), pa.array(feistel(seq, total, key)), batch.column(2), batch.column(3)], schema=schema)

    return packed.mapInArrow(run, "seq long, slot long, ids binary, doc_ids array<long>")


MOVED = "shard long, slots array<long>, seqs array<long>, ids binary, doc_ids array<array<long>>"
WRITTEN = "slot long, seq long, shard long, byte_offset long, n_tokens int, ids_sha256 string, doc_ids array<long>"


def write(numbered: DataFrame, folder: str, shard: int = SHARD) -> DataFrame:
    """Writes the shards below ``folder``; one row for each sequence with its place and its digest.

    A task first puts together what it has for each shard, compressed, so few and small rows move.
    Rows of a shard are together, because tasks are ranges of shards; they hold one shard at a time.
    """
    spark = numbered.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    moved, schema = arrow_type(MOVED), arrow_type(WRITTEN)

    def gather(batches):
        press = zstandard.ZstdCompressor(level=PRESS)
        for batch in batches:
            slots = batch.column(1).to_numpy()
            order = np.argsort(slots)
            edges = np.flatnonzero(np.diff(slots[order] // shard, prepend=-1, append=-1)) if len(order) else []
            rows = []
            for a, b in zip(edges, edges[1:]):
                own = batch.take(pa.array(order[a:b]))
                ids = press.compress(b"".join(own.column(2).to_pylist()))
                rows.append({"shard": int(slots[order[a]] // shard), "slots": own.column(1).to_pylist(), "seqs": own.column(0).to_pylist(), "ids": ids, "doc_ids": own.column(3).to_pylist()})
            yield pa.RecordBatch.from_pylist(rows, schema=moved)

    def run(batches):
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        unpress, held, now = zstandard.ZstdDecompressor(), [], None

        def done():
            rows = []
            for row in held:
                ids = unpress.decompress(row["ids"])
                stride = len(ids) // len(row["slots"])
                rows += [(slot, seq, ids[i * stride : (i + 1) * stride], docs) for i, (slot, seq, docs) in enumerate(zip(row["slots"], row["seqs"], row["doc_ids"]))]
            rows.sort(key=lambda r: r[0])
            name = f"{base}/shard-{now:08d}.bin"
            fresh = f"{name}.{uuid.uuid4().hex[:8]}"
            with files.open_output_stream(fresh) as out:
                out.write(b"".join(r[2] for r in rows))
            files.move(fresh, name)
            out = [{"slot": slot, "seq": seq, "shard": now, "byte_offset": slot % shard * len(ids), "n_tokens": len(ids) // 2, "ids_sha256": hashlib.sha256(ids).hexdigest(), "doc_ids": docs} for slot, seq, ids, docs in rows]
            held.clear()
            return pa.RecordBatch.from_pylist(out, schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if held and row["shard"] != now:
                    yield done()
                now = row["shard"]
                held.append(row)
        if held:
            yield done()

    rows = numbered.select("seq", "slot", "ids", "doc_ids").mapInArrow(gather, MOVED)
    return rows.repartitionByRange(tasks, "shard").sortWithinPartitions("shard").mapInArrow(run, WRITTEN)


def read_slots(folder: str, first: int, count: int, length: int = SEQUENCE, shard: int = SHARD) -> np.ndarray:
    """Sequences of ``count`` slots from ``first`` on, as a reader resumes: one seek for each file."""
    files, base = fs.FileSystem.from_uri(folder)
    out = []
    while count > 0:
        with files.open_input_file(f"{base}/shard-{first // shard:08d}.bin") as f:
            take = min(count, shard - first % shard)
            f.seek(first % shard * 2 * length)
            data = f.read(take * 2 * length)
        if not data:
            break
        out.append(np.frombuffer(data, "<u2").reshape(-1, length))
        first, count = first + take, count - take
    return np.concatenate(out) if out else np.zeros((0, length), "<u2")


def materialise(docs: DataFrame, vocabulary: Vocabulary, folder: str | None = None, length: int = SEQUENCE, shard: int = SHARD, key: int = KEY) -> DataFrame:
    """Encodes, packs, permutes and writes ``docs``; one row for each sequence.

    ``slot, seq, shard, byte_offset, n_tokens, ids_sha256, doc_ids``.  Slots are 0 to n - 1 without gaps.
    Null ids stay null in ``doc_ids``; repeated rows are packed each; no rows give no sequences
    and no files; further columns are not read.  ``folder`` defaults to a new one below the shared
    checkpoint folder.
    """
    if folder is None:
        ensure_checkpoints(docs.sparkSession)
        folder = f"{docs.sparkSession.sparkContext.getCheckpointDir().rstrip('/')}/shards-{uuid.uuid4().hex[:12]}"
    scheme, mark, path = folder.partition(":")
    if not mark or scheme == "file":
        folder = "file:///" + (path or folder).lstrip("/")
    return write(number(stored(pack(docs, vocabulary, length), "sequences", "zstd", PRESS + 1), key), folder, shard)
