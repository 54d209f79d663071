"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: one probe and one comparison tell whether a whole
pre-token is a vocabulary entry. Tier two merges the bytes of the others on a doubly linked list with a heap of
neighbouring pairs by rank. Resolved pre-tokens are remembered in a bounded table per task.
"""
from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

_MASK = (1 << 64) - 1
REMEMBER = 400_000
BATCH_BYTES = 4_000_000


@dataclass
class PerfectHash:
    """Hash and displace: entry `rank[slot]` sits at slot = (hi + d * step) % n with d of its bucket;
    negative d names the slot of a bucket of one entry. Every slot is used."""

    keys: list[bytes]
    displace: np.ndarray
    rank: np.ndarray

    @classmethod
    def build(cls, keys: list[bytes]) -> PerfectHash:
        n = len(keys)
        m = max(1, n // 3)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        buckets: list[list[int]] = [[] for _ in range(m)]
        for i, h in enumerate(hashes):
            buckets[h % m].append(i)
        displace, rank = np.zeros(m, np.int64), np.full(n, -1, np.int64)
        free = bytearray(b"\1") * n
        for b in sorted(range(m), key=lambda b: -len(buckets[b])):
            own = buckets[b]
            if len(own) < 2:
                break
            for d in range(1 << 31):
                slots = [cls._slot(hashes[i], d, n) for i in own]
                if len(set(slots)) == len(own) and all(free[s] for s in slots):
                    break
            displace[b] = d
            for i, s in zip(own, slots, strict=True):
                rank[s], free[s] = i, 0
        left = iter([s for s in range(n) if free[s]])
        for b in range(m):
            if len(buckets[b]) == 1:
                s = next(left)
                displace[b], rank[s] = -s - 1, buckets[b][0]
        return cls(keys, displace, rank)

    @staticmethod
    def _slot(h: int, d: int, n: int) -> int:
        return ((h >> 32) + d * ((h & 0x7FFFFFFF) | 1) + d * d) % n

    def get(self, key: bytes) -> int:
        """The entry's number, or -1."""
        if not self.keys:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        d = int(self.displace[h % len(self.displace)])
        i = int(self.rank[-d - 1 if d < 0 else self._slot(h, d, len(self.keys))])
        return i if self.keys[i] == key else -1


@dataclass
class Vocabulary:
    pieces: list[bytes]  # by id; empty where an id is unused
    ranks: dict[bytes, int]
    table: PerfectHash
    ids: np.ndarray  # of the table's entries

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a file of lines `base64 rank`."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
        pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for p, r in ranks.items():
            pieces[r] = p
        keys = list(ranks)
        return cls(pieces, ranks, PerfectHash.build(keys), np.array([ranks[k] for k in keys], np.int64))


def merge(text: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: always the pair of lowest rank, leftmost first.

    Parts are a linked list over byte positions; a heap entry is stale once its parts have changed.
    """
    n = len(text)
    end = list(range(1, n + 1))  # end of the part that starts here; 0 where none starts
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(text[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, mid, stop = heappop(heap)
        if end[i] != mid or mid >= n or end[mid] != stop:
            continue
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(text[i : end[stop]])) is not None:
                heappush(heap, (r, i, stop, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(text[p:stop])) is not None:
            heappush(heap, (r, p, i, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[text[i : end[i]]])
        i = end[i]
    return out


class Encoder(dict):
    """Pre-token -> its ids as little-endian 32-bit integers, filled on demand."""

    def __init__(self, vocabulary: Vocabulary, pattern: str) -> None:
        import regex

        super().__init__()
        self.vocabulary, self.split = vocabulary, regex.compile(pattern).findall

    def __missing__(self, token: str) -> bytes:
        raw = token.encode()
        v = self.vocabulary
        i = v.table.get(raw)
        ids = [int(v.ids[i])] if i >= 0 else merge(raw, v.ranks)
        out = np.array(ids, "<u4").tobytes()
        if len(self) >= REMEMBER:
            self.clear()
        if len(token) < 100:
            self[token] = out
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))


def _added(batches: Iterator[pa.RecordBatch], source: str, out: str, f) -> Iterator[pa.RecordBatch]:
    """The batches with a binary column `out`; cut so that no Arrow batch grows far beyond BATCH_BYTES."""
    for batch in batches:
        column = batch.column(source)
        first, held, got = 0, 0, []
        for k in range(len(column)):
            x = column[k].as_py()
            got.append(f(x))
            held += 0 if x is None else len(x)
            if held > BATCH_BYTES or k == len(column) - 1:
                part = batch.slice(first, k + 1 - first)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.binary())], [*batch.schema.names, out])
                first, held, got = k + 1, 0, []


def _schema(df: DataFrame, out: str):
    from pyspark.sql.types import BinaryType, StructType

    return StructType([*df.schema.fields]).add(out, BinaryType())


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add `out`: the ids of `text` as little-endian unsigned 32-bit integers. Null and empty texts have none.

    `path` is read by the driver; vocabulary and hash, of fixed size, are broadcast. Special tokens are ordinary
    text. Rows and other columns stay; a column called `out` is replaced.
    """
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        yield from _added(batches, text, out, lambda x: encoder.encode(x or ""))

    return docs.mapInArrow(run, _schema(docs, out))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add `out`: the bytes that `ids` stand for. Null ids give no bytes, an id beyond the vocabulary is an error."""
    df = df.drop(out)
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.load(path).pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = shared.value.__getitem__
        yield from _added(batches, ids, out, lambda x: b"".join(map(piece, np.frombuffer(x or b"", "<u4").tolist())))

    return df.mapInArrow(run, _schema(df, out))
