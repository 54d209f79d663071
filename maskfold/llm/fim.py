"""Fill-in-middle: texts cut into prefix, middle and suffix at unit borders, and put back in another order.

A wavelet matrix over the character classes of many texts at once answers how many characters of a class stand
before a position. Sums of these ranks count units and code points, and bisection on them finds the cuts; texts are
never split into their units.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays

#: classes of UTF-8 bytes
OTHER, BLANK, NEWLINE, TAIL, STOP = range(5)
BITS = 3
CLASS = np.zeros(256, np.uint8)
CLASS[[9, 11, 12, 13, 32]] = BLANK
CLASS[10] = NEWLINE
CLASS[0x80:0xC0] = TAIL  # the later bytes of a code point
CLASS[[ord(c) for c in ".!?"]] = STOP

#: a unit ends with a character of one of these classes, or with the text
UNITS = {"line": (NEWLINE,), "sentence": (STOP, NEWLINE), "word": (BLANK, NEWLINE)}
MARKS = ("<P>", "<S>", "<M>")


class Wavelet:
    """Rank of any class before any position, by one stable partition per bit of the class."""

    def __init__(self, codes: np.ndarray, bits: int = BITS) -> None:
        self.planes = []
        self.bits = bits
        for b in reversed(range(bits)):
            bit = (codes >> b) & 1
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(codes) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            self.planes.append((words, before, len(codes) - int(before[-1])))
            codes = np.concatenate([codes[bit == 0], codes[bit == 1]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(words[word] & low)

    def rank(self, code: int, at: np.ndarray) -> np.ndarray:
        """How many of the first `at` codes are `code`."""
        first, at = np.zeros(1, np.int64), np.asarray(at, np.int64)
        for b, (words, before, zeros) in zip(reversed(range(self.bits)), self.planes, strict=True):
            if code >> b & 1:
                first, at = zeros + self._ones(words, before, first), zeros + self._ones(words, before, at)
            else:
                first, at = first - self._ones(words, before, first), at - self._ones(words, before, at)
        return at - first

    def ranks(self, codes: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        return sum(self.rank(c, at) for c in codes)

    def find(self, codes: tuple[int, ...], rank: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest position of low..high with at least `rank` of the codes before it, else `high`; by bisection."""
        low, high = low.copy(), high.copy()
        while (low < high).any():
            mid = (low + high) >> 1
            enough = self.ranks(codes, mid) >= rank
            high, low = np.where(enough, mid, high), np.where(enough, low, np.minimum(mid + 1, high))
        return low


CUTS = pa.struct([("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def cuts(texts: pa.Array, h1: np.ndarray, h2: np.ndarray, unit: str) -> pa.Array:
    """Per text: its number of units and the code points before the two cuts, after h % (n + 1) units each, the smaller first."""
    ends = UNITS[unit]
    data, off = arrays.column_bytes(texts)
    out = [np.zeros((3, 0), np.int64)]
    first = 0
    while first < len(off) - 1:  # pieces of about a megabyte, a longer text alone
        last = max(first + 1, int(np.searchsorted(off, off[first] + arrays.PIECE, "right")) - 1)
        by, at = data[off[first] : off[last]], off[first : last + 1] - off[first]
        w = Wavelet(CLASS[by])
        start, end = at[:-1], at[1:]
        before, upto = w.ranks(ends, start), w.ranks(ends, end)
        n = upto - before
        n = n + ((end > start) & (w.ranks(ends, np.maximum(end - 1, start)) == upto))  # what follows the last end is a unit
        k1, k2 = h1[first:last] % (n + 1), h2[first:last] % (n + 1)
        points = lambda p: (p - start) - (w.rank(TAIL, p) - w.rank(TAIL, start))  # noqa: B023, E731
        where = [points(w.find(ends, before + k, start, end)) for k in (np.minimum(k1, k2), np.maximum(k1, k2))]
        out.append(np.stack([n, *where]))
        first = last
    got = np.concatenate(out, 1)
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in got], fields=list(CUTS))


def _cutter(unit: str):
    @F.arrow_udf("struct<n:bigint,a:bigint,b:bigint>")
    def run(texts: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        return cuts(texts, h1.to_numpy(zero_copy_only=False), h2.to_numpy(zero_copy_only=False), unit)

    return run


def transform(
    docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "line", rate: int = 100, spm: int = 50, seed: int = 7,
    marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) for each row of `docs`, cut at borders of `unit`.

    Four numbers of the SHA-256 of seed and key decide: two cuts after 0 to n units, whether the text stays plain
    (`rate` of 100 do not), and the form spm (`spm` of 100) or psm. Empty and null texts and texts that hold a mark stay plain, with
    null for the chars. A null key counts as the empty string, so null-keyed texts share their numbers. Repeated rows have
    equal results, an empty table gives no rows, other columns are ignored whatever their names. A text of any length
    is one row of one task, with about twenty times its bytes at hand.
    """
    if any(m.find(m[0], 1) > 0 or o != m and m[0] in o[1:] for m in marks for o in marks):
        raise ValueError("a mark's first character must stand nowhere else in the marks")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    number = lambda i: F.conv(F.substring("d", 8 * i + 1, 8), 16, 10).cast("long")
    base = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), digest.alias("d"))
    base = base.withColumn("cut", _cutter(unit)("t", number(0), number(1)))
    holds = F.lit(False)
    for m in marks:
        holds = holds | F.contains("t", F.lit(m))
    plain = (F.col("t") == "") | holds | (number(2) % 100 >= rate)
    form = F.when(plain, "plain").when(number(3) % 100 < spm, "spm").otherwise("psm")
    base = base.select("k", "t", F.col("cut.n").alias("n"), F.col("cut.a").cast("int").alias("a"), F.col("cut.b").cast("int").alias("b"), form.alias("form"))
    prefix, middle, suffix = F.expr("left(t, a)"), F.expr("substring(t, a + 1, b - a)"), F.expr("substring(t, b + 1)")
    p, s, m = map(F.lit, marks)
    output = (
        F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
        .when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle))
        .otherwise(F.col("t"))
    )
    cut = F.col("form") != "plain"
    return base.select(
        F.col("k").alias(key), "n", "form", F.when(cut, F.col("a").cast("long")).alias("prefix_chars"),
        F.when(cut, (F.col("b") - F.col("a")).cast("long")).alias("middle_chars"), output.alias("output"),
    )


def _between(t: Column, left: str, right: str | None) -> Column:
    """What follows the first `left`, up to the first `right` after it."""
    rest = F.substring(t, F.locate(left, t) + F.lit(len(left)), F.length(t))
    return rest if right is None else F.substring_index(rest, right, 1)


def restore(done: DataFrame, marks: tuple[str, str, str] = MARKS, out: str = "restored") -> DataFrame:
    """Add `out`: the original text, from `output` and `form` alone. A column of that name is replaced.

    No text that was cut holds a mark, and no end of a text joins with the begin of a mark to another one, so the first
    of each mark is the one put in.
    """
    p, s, m = marks
    t = F.col("output")
    middle = _between(t, m, None)
    psm = F.concat(_between(t, p, s), middle, _between(t, s, m))
    spm = F.concat(_between(t, p, m), middle, _between(t, s, p))
    return done.withColumn(out, F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(t))

