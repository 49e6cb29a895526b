"""Byte-pair encoding by forced boundaries, and decoding.

A pair of neighbouring bytes that no vocabulary token holds inside it can never be merged, so a
text may be cut there with certainty.  The pairs are read off the vocabulary.  Two levels use them:

* before a white-space character: a text is cut into fragments, which are encoded independently of
  each other and once for each distinct fragment that a task remembers;
* inside a piece of the pre-tokenizer's pattern: the merges run on each stretch between two forced
  boundaries.

Cuts of the first kind are also boundaries of the pattern, because no alternative of it goes on from
another character into white space and its look-ahead only regards white space itself.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from codemem.llm.common import SPACE_BYTES, over_texts

# Fixed value: the pattern that splits a text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Distinct fragments and pieces that a task remembers twice over: a full half becomes the older one.
MEMORY = 300_000

# Bytes of a stretch beyond which its pairs are kept in a heap.
LONG_STRETCH = 64

_NONE = 1 << 62


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ForcedBpe:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.byte_id = {self.bytes_of[i]: i for i in vocab.values()}
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left] << 20 | vocab[right]] = rank << 20 | vocab[left + right]
        inside = {token[i : i + 2] for i in vocab.values() for token in [self.bytes_of[i]] for i in range(len(token) - 1)}
        self.free = frozenset((a, b) for a in range(256) for b in range(256) if bytes((a, b)) not in inside)
        self.free_pair = bytearray(bytes((a, b)) not in inside for a in range(256) for b in range(256))
        self.byte_ids = [self.byte_id.get(bytes([b]), 0) for b in range(256)]
        self.first_rank = [self.merges.get(a << 20 | b, _NONE) for a in self.byte_ids for b in self.byte_ids]
        # A fragment ends before white space, unless some token holds the two bytes around that place.
        solid = [b for b in range(256) if b not in SPACE_BYTES]
        tied = bytes(sorted({b for b in solid for w in SPACE_BYTES if (b, w) not in self.free}))
        space, on = b"[" + re.escape(SPACE_BYTES) + b"]", b"(?<=[" + re.escape(tied) + b"])" if tied else b"(?!)"
        word = b"[^" + re.escape(SPACE_BYTES) + b"]+"
        self.fragments = re.compile(b"%b*%b(?:%b%b+%b)*(?:%b%b+$)?|%b+" % (space, word, on, space, word, on, space, space))
        # Other white space joins a run of these in the pattern's look-ahead; such texts are cut with care.
        self.odd_space = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
        self.careful = re.compile("(?<=\\S)(?=[" + re.escape(SPACE_BYTES.decode()) + "])")
        self.tied = frozenset(tied)
        self.pieces = regex.compile(PATTERN)
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.names = {i: str(i) for i in self.bytes_of}
        self.known: dict[bytes, tuple[int, ...]] = {}
        self.older: dict[bytes, tuple[int, ...]] = {}

    def merge(self, piece: bytes, pairs: list[int] | None = None) -> list[int]:
        """Ids of a stretch without forced boundaries: merges by rank, leftmost first; ``pairs`` are its pairs of bytes."""
        if len(piece) > LONG_STRETCH:
            return self.merge_long(piece)
        ids = [*map(self.byte_ids.__getitem__, piece)]
        if pairs is None:
            pairs = [a << 8 | b for a, b in zip(piece, piece[1:])]
        ranks = [*map(self.first_rank.__getitem__, pairs)]
        rank = self.merges.get
        while ranks and (best := min(ranks)) != _NONE:
            i = ranks.index(best)
            new = ids[i] = best & 0xFFFFF
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 20 | new, _NONE)
            if i < len(ranks):
                ranks[i] = rank(new << 20 | ids[i + 1], _NONE)
        return ids

    def merge_long(self, piece: bytes) -> list[int]:
        """The same merges in n log n: neighbours in a linked list, pairs in a heap by rank and place."""
        ids = [*map(self.byte_ids.__getitem__, piece)]
        n, merges = len(ids), self.merges
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        pairs = [(merges.get(a << 20 | b, _NONE), i) for i, (a, b) in enumerate(zip(ids, ids[1:]))]
        heap = [p for p in pairs if p[0] != _NONE]
        heapq.heapify(heap)
        while heap:
            best, i = heapq.heappop(heap)
            j = after[i]
            # A pair that has changed since is no longer the one that was put here.
            if ids[i] < 0 or j >= n or merges.get(ids[i] << 20 | ids[j], _NONE) != best:
                continue
            ids[i], ids[j] = best & 0xFFFFF, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if right < n and (rank := merges.get(ids[left] << 20 | ids[right], _NONE)) != _NONE:
                    heapq.heappush(heap, (rank, left))
        return [i for i in ids if i >= 0]

    def piece(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece of the pattern: each stretch between forced boundaries on its own."""
        pairs = [a << 8 | b for a, b in zip(piece, piece[1:])]
        free = bytes(map(self.free_pair.__getitem__, pairs))
        end = free.find(1)
        if end < 0:
            return tuple(self.merge(piece, pairs))
        out, start = [], 0
        while end >= 0:
            out += self.merge(piece[start : end + 1], pairs[start:end])
            start, end = end + 1, free.find(1, end + 1)
        return tuple(out + self.merge(piece[start:], pairs[start:]))

    def remember(self, known: bytes, ids: tuple[int, ...]) -> tuple[int, ...]:
        if len(known) <= 64:
            if len(self.known) >= MEMORY:
                self.older, self.known = self.known, {}
            self.known[known] = ids
        return ids

    def fragment(self, data: bytes) -> tuple[int, ...]:
        """Ids of one fragment, by the pattern's pieces, of which many are known from other fragments."""
        if (ids := self.older.get(data)) is not None:
            return self.remember(data, ids)
        # Letters alone, after a blank at most, are one piece: most fragments need no pattern.
        if (data[1:] if data[:1] == b" " else data).isalpha():
            return self.remember(data, self.piece(data))
        pieces = [p.encode() for p in self.pieces.findall(data.decode())]
        if len(pieces) == 1:
            return self.remember(data, self.piece(data))
        out: tuple[int, ...] = ()
        for piece in pieces:
            ids = self.known.get(piece)
            if ids is None and (ids := self.older.get(piece)) is None:
                ids = self.remember(piece, self.piece(piece))
            out += ids
        return self.remember(data, out)

    def split(self, text: str) -> list[bytes]:
        """Fragments of a text without special tokens; joined they are the text."""
        if text.isascii() or not self.odd_space.search(text):
            return self.fragments.findall(text.encode())
        out: list[bytes] = []
        for part in self.careful.split(text):
            part = part.encode()
            if out and out[-1][-1] in self.tied:
                out[-1] += part
            elif part:
                out.append(part)
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known
        for part in self.specials.split(text) if self.specials and any(s in text for s in self.special) else (text,):
            if part in self.special:
                out.append(self.special[part])
                continue
            for fragment in self.split(part):
                ids = known.get(fragment)
                if ids is None:
                    ids = self.fragment(fragment)
                    known = self.known
                out += ids
        return out

    def decode(self, ids) -> str:
        """Text of ids; ids outside the vocabulary are left out, bytes that form no character are replaced."""
        table = self.bytes_of
        try:
            data = b"".join(map(table.__getitem__, ids))
        except KeyError:
            data = b"".join(table.get(i, b"") for i in ids)
        return data.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _load(text: str) -> ForcedBpe:
    return ForcedBpe(text)


class Vocabulary:
    """A vocabulary file's text, read by the driver and sent to the tasks; a few MB whatever the input."""

    def __init__(self, spark, path: str):
        with open(path, encoding="utf-8") as f:
            self.text = spark.sparkContext.broadcast(f.read())

    @property
    def codec(self) -> ForcedBpe:
        return _load(self.text.value)


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """``doc_id, ids`` of every row: the ids of the whole text.

    A null or empty text has no ids.  Repeated rows are encoded each; other columns are not read.
    """
    def work(part, data, offsets):
        codec = vocabulary.codec
        texts = part.column(1).to_pylist()
        return {"doc_id": part.column(0), "ids": pa.array([codec.encode(t or "") for t in texts], pa.list_(pa.int32()))}

    return over_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")), work, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``; a null list is an empty text, null ids are left out."""
    from codemem.llm.common import arrow_type

    schema = arrow_type("doc_id long, text string")

    def run(batches):
        codec = vocabulary.codec
        for batch in batches:
            texts = [codec.decode([i for i in ids if i is not None] if ids else ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema=schema)

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, encoded and decoded in one visit.

    Null and empty texts have no tokens; their digests are those of an empty string.
    """
    def work(part, data, offsets):
        codec = vocabulary.codec
        counts, of_ids, of_text = [], [], []
        for text in part.column(1).to_pylist():
            ids = codec.encode(text or "")
            counts.append(len(ids))
            of_ids.append(hashlib.sha256(",".join(map(codec.names.__getitem__, ids)).encode()).hexdigest())
            of_text.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
        return {"doc_id": part.column(0), "n_tokens": counts, "ids_sha256": of_ids, "decoded_sha256": of_text}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return over_texts(rows, work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
