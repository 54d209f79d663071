"""Count items over a whole corpus and bring the counts back to the texts they come from.

Texts are dealt to batches of a few megabytes. A batch sends each distinct item (a 64-bit hash) once, packed by
bucket of the item space, with its count; a bucket adds up what all batches sent and answers every batch in the
order it sent. Rows of the shuffle are packed arrays instead of one row per item, a frequent item costs a batch
one entry, and texts are shuffled once because both sides of the query reuse that exchange.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 6_000_000
BUCKET_ITEMS = 2_000_000


@dataclass(frozen=True)
class Layout:
    """`batches` and `buckets` follow the size of the corpus; `item_bytes` of an item's hash are sent.

    A bucket holds about BUCKET_ITEMS items at any size, so two of its items share their sent part with a
    chance of 5e-4 at 4 bytes and 2e-6 at 5.
    """

    batches: int
    buckets: int
    item_bytes: int

    @classmethod
    def of(cls, n_bytes: int, n_items: int, item_bytes: int) -> Layout:
        return cls(max(1, -(-n_bytes // BATCH_BYTES)), max(1, min(1 << 24, -(-n_items // BUCKET_ITEMS))), item_bytes)

    def short(self, item: np.ndarray) -> np.ndarray:
        """The part of a hash that is sent; within a bucket it stands for the item."""
        return (item // np.uint64(self.buckets)) & np.uint64((1 << (8 * self.item_bytes)) - 1)

    def pack(self, short: np.ndarray) -> bytes:
        """Ascending parts as differences, byte plane by byte plane: the upper planes are nearly empty and compress."""
        gaps = short.copy()
        gaps[1:] -= short[:-1]
        return planes(gaps)[: self.item_bytes * len(short)]

    def unpack(self, raw: bytes) -> np.ndarray:
        n = len(raw) // self.item_bytes
        wide = np.zeros((8, n), np.uint8)
        wide[: self.item_bytes] = np.frombuffer(raw, np.uint8).reshape(self.item_bytes, n)
        return np.cumsum(np.ascontiguousarray(wide.T).view("<u8").ravel(), dtype=np.uint64)

    def ordered(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bucket, sent part, and for each item its place among the batch's distinct (bucket, part) in sending order."""
        width = np.uint64(8 * self.item_bytes)
        both = (items % np.uint64(self.buckets) << width) | self.short(items)
        distinct, place = np.unique(both, return_inverse=True)
        return (distinct >> width).astype(np.int64), distinct & np.uint64((1 << int(width)) - 1), place


def planes(x: np.ndarray) -> bytes:
    """Little-endian values (one row or column of them per item) byte plane by byte plane."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T).tobytes() if len(x) else b""


def from_planes(raw: bytes, dtype: str, columns: int) -> np.ndarray:
    width = np.dtype(dtype).itemsize * columns
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(dtype)


SENT = "bucket long, batch long, items binary, counts binary"
ANSWER = "batch long, bucket long, answer binary"


def send(layout: Layout, batch: int, items: np.ndarray, weights: np.ndarray) -> pa.Table:
    """What a batch sends: `weights` (len(items) x k) summed per distinct item."""
    bucket, short, place = layout.ordered(items)
    k = weights.shape[1]
    total = np.stack([np.bincount(place, weights[:, j], len(bucket)) for j in range(k)], 1).astype("<u4")
    cut = np.searchsorted(bucket, np.unique(bucket)).tolist() + [len(bucket)]
    parts = list(zip(cut[:-1], cut[1:], strict=True))
    return pa.table({
        "bucket": pa.array([int(bucket[a]) for a, _ in parts], pa.int64()),
        "batch": pa.array([batch] * len(parts), pa.int64()),
        "items": pa.array([layout.pack(short[a:b]) for a, b in parts], pa.binary()),
        "counts": pa.array([planes(total[a:b]) for a, b in parts], pa.binary()),
    })


def answer(layout: Layout, k: int, reply: Callable[[np.ndarray], np.ndarray]):
    """Group function of one bucket: totals per item, `reply(totals)` (a row per item) for each batch in its order.

    A batch's counts fit 32 bits, as its size is bounded; totals are exact up to 2**53 and want 64 bits in the reply.
    """

    def run(t: pa.Table) -> pa.Table:
        items = [layout.unpack(x.as_py()) for x in t.column("items")]
        counts = np.concatenate([from_planes(x.as_py(), "<u4", k) for x in t.column("counts")])
        _, place = np.unique(np.concatenate(items), return_inverse=True)
        n = int(place.max()) + 1 if len(place) else 0
        value = reply(np.stack([np.bincount(place, counts[:, j], n) for j in range(k)], 1))
        back, at = [], 0
        for i in items:
            back.append(planes(value[place[at : at + len(i)]]))
            at += len(i)
        return pa.table({"batch": t.column("batch"), "bucket": t.column("bucket"), "answer": pa.array(back, pa.binary())})

    return run


def answers(t: pa.Table, dtype: str, columns: int) -> np.ndarray:
    """A batch's answers in sending order, one row per item."""
    order = np.argsort(t.column("bucket").to_numpy(), kind="stable")
    col = t.column("answer")
    return np.concatenate([np.zeros((0, columns), dtype), *[from_planes(col[int(i)].as_py(), dtype, columns) for i in order]])


def batch_of(layout: Layout, *cols: str):
    return F.pmod(F.xxhash64(*cols), F.lit(layout.batches)).cast("long")
