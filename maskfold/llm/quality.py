"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

Statistics of the whole text pass through fixed random cosines, whose inner products approximate a Gaussian
kernel. Each partition sums its share of X'X and X'y, only these sums of fixed size meet; the driver solves one
small system. A part of the labelled rows calibrates the raw scores by pool-adjacent-violators.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from maskfold.plans.materialise import materialise

from . import arrays

STATS = (
    "log_words", "mean_word", "std_word", "long_words", "distinct_words", "repeated_windows", "repeated_lines",
    "log_line_words", "upper", "digits", "marks", "symbols", "end_marks", "other_bytes", "byte_entropy", "exclaim",
)
FEATURES = 192
WIDTH = 4.0  # of the Gaussian kernel, in standard deviations of the statistics
RIDGE = 1e-3
BINS = 2_000
SEED = 7

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_CLASSES = {
    "upper": _UPPER,
    "digits": np.isin(np.arange(256), np.frombuffer(b"0123456789", np.uint8)),
    "marks": np.isin(np.arange(256), np.frombuffer(b".,;:'\"()-?", np.uint8)),
    "symbols": np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8)),
    "exclaim": np.isin(np.arange(256), np.frombuffer(b"!", np.uint8)),
    "other_bytes": np.arange(256) >= 128,
}


def _of_piece(p: arrays.Piece) -> np.ndarray:
    out = np.zeros((p.rows, len(STATS)))
    col = {n: i for i, n in enumerate(STATS)}
    sizes = np.diff(p.offsets)
    n = np.diff(p.bounds)
    length = (p.end - p.start).astype(float)
    some = np.maximum(n, 1)

    def per_row(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(x)])
        return total[p.bounds[1:]] - total[p.bounds[:-1]]

    mean = per_row(length) / some
    out[:, col["log_words"]] = np.log1p(n)
    out[:, col["mean_word"]] = mean
    out[:, col["std_word"]] = np.sqrt(np.maximum(per_row(length**2) / some - mean**2, 0))
    out[:, col["long_words"]] = per_row(length > 14) / some
    for name, table in _CLASSES.items():
        total = np.concatenate([[0], np.cumsum(table[p.data])])
        out[:, col[name]] = (total[p.offsets[1:]] - total[p.offsets[:-1]]) / np.maximum(sizes, 1)
    last = p.data[p.end - 1] if len(p.end) else np.zeros(0, np.uint8)
    out[:, col["end_marks"]] = per_row(np.isin(last, np.frombuffer(b".!?", np.uint8))) / some
    window = arrays.mix(arrays.mix(p.hash[:-2] * np.uint64(3) + p.hash[1:-1]) * np.uint64(3) + p.hash[2:]) if len(p.hash) > 2 else np.zeros(0, np.uint64)
    newline = np.flatnonzero(p.data == 10)
    for i in range(p.rows):
        a, b, lo, hi = p.bounds[i], p.bounds[i + 1], p.offsets[i], p.offsets[i + 1]
        if a == b:
            continue
        out[i, col["distinct_words"]] = len(np.unique(p.hash[a:b])) / (b - a)
        if b - a > 2:
            out[i, col["repeated_windows"]] = 1 - len(np.unique(window[a : b - 2])) / (b - a - 2)
        cut = newline[np.searchsorted(newline, lo) : np.searchsorted(newline, hi)]
        starts, ends = np.concatenate([[lo], cut + 1]), np.concatenate([cut, [hi]])
        filled = np.searchsorted(p.start, starts) < np.searchsorted(p.start, ends)
        lines = arrays.span_hashes(p.data[lo:hi], starts[filled] - lo, ends[filled] - lo)
        out[i, col["repeated_lines"]] = 1 - len(np.unique(lines)) / len(lines)
        out[i, col["log_line_words"]] = np.log1p((b - a) / len(lines))
        share = np.bincount(p.data[lo:hi], minlength=256) / (hi - lo)
        share = share[share > 0]
        out[i, col["byte_entropy"]] = -(share * np.log2(share)).sum()
    return out


def statistics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, stats) per row; null, empty and blank texts have no words and zeros for shares. Rows stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for p in arrays.pieces(batch.column(1)):
                flat = _of_piece(p).ravel()
                ends = np.arange(0, len(flat) + 1, len(STATS), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([keys.slice(p.first, p.rows), pa.ListArray.from_arrays(ends, pa.array(flat))], [key, "stats"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, stats array<double>")


@dataclass
class Model:
    """Everything needed to score, of fixed size."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    raw: np.ndarray  # calibration: knots
    share: np.ndarray  # and their share of label 1

    def features(self, stats: np.ndarray) -> np.ndarray:
        return _cosines(np.clip((stats - self.mean) / self.scale, -6, 6))

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.features(stats) @ self.weights
        return np.interp(raw, self.raw, self.share)


def _cosines(z: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    w = rng.normal(size=(len(STATS), FEATURES)) / WIDTH
    phase = rng.uniform(0, 2 * np.pi, FEATURES)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ w + phase), np.ones((len(z), 1)), z * 0.1])


def isotonic(x: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step fit to good / n at ascending x (pool adjacent violators), joined by lines."""
    blocks: list[list[float]] = []
    for a, g, m in zip(x, good, n, strict=True):
        blocks.append([a * m, g, m])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATS))


def train(rows: DataFrame, calibration: Column) -> Model | None:
    """A model of `rows` (stats, label 0/1); rows where `calibration` is true set the calibration only.

    None without rows to fit. With nothing to calibrate on, the fitted rows serve for that, too.
    """
    spark = rows.sparkSession
    rows = rows.select("stats", F.col("label").cast("double").alias("label"), F.coalesce(calibration, F.lit(False)).alias("held"))
    each = [f for i in range(len(STATS)) for f in (F.avg(F.col("stats")[i]), F.stddev_pop(F.col("stats")[i]))]
    first = rows.agg(F.count(F.when(~F.col("held"), 1)), F.count(F.when(F.col("held"), 1)), *each).first()
    if not first[0]:
        return None
    some_held = bool(first[1])
    mean = np.array(first[2::2], float)
    scale = np.array(first[3::2], float)
    scale[scale < 1e-9] = 1.0
    blank = Model(mean, scale, np.zeros(0), np.zeros(0), np.zeros(0))
    width = FEATURES + 1 + len(STATS)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.zeros((width, width + 1))
        for batch in batches:
            x, y = blank.features(_matrix(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False)
            a[:, :width] += x.T @ x
            a[:, width] += x.T @ y
        if a.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(list(a))], ["i", "v"])

    def add(t: pa.Table) -> pa.Table:
        v = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, width + 1).sum(axis=0)
        return pa.table({"i": t.column("i").slice(0, 1), "v": pa.array([v])})

    fit = rows.where(~F.col("held")).select("stats", "label").mapInArrow(sums, "i int, v array<double>")
    got = fit.groupBy("i").applyInArrow(add, "i int, v array<double>").collect()  # `width` rows whatever the input
    a = np.zeros((width, width + 1))
    for r in got:
        a[r["i"]] = r["v"]
    weights = np.linalg.solve(a[:, :width] + RIDGE * first[0] / width * np.eye(width), a[:, width])
    model = Model(mean, scale, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    shared = spark.sparkContext.broadcast(model)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = shared.value
            raw = m.features(_matrix(batch.column(0))) @ m.weights
            at = np.rint(np.clip(raw, -0.5, 1.5) * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], ["bin", "label"])

    held = rows.where("held") if some_held else rows
    table = held.select("stats", "label").mapInArrow(bins, "bin int, label double")
    found = table.groupBy("bin").agg(F.sum("label").alias("good"), F.count("*").alias("n")).orderBy("bin").collect()  # at most 2 * BINS + 1 rows
    x, good, n = (np.array([r[k] for r in found], float) for k in ("bin", "good", "n"))
    model.raw, model.share = isotonic(x / BINS, good, n)
    return model


def score(stats: DataFrame, model: Model | None, key: str = "doc_id") -> DataFrame:
    """(key, score, predicted) of (key, stats); 0.5 and 1 for all rows without a model."""
    if model is None:
        return stats.select(key, F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.score(_matrix(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [key, "score", "predicted"])

    kind = dict(stats.dtypes)[key]
    return stats.select(key, "stats").mapInArrow(run, f"`{key}` {kind}, score double, predicted int")


def score_texts(docs: DataFrame, model: Model | None, text: str = "text", out: str = "score") -> DataFrame:
    """The rows and columns of `docs` with the score of each text as `out`; statistics are taken on the way, no shuffle."""
    docs = docs.drop(out)
    if model is None:
        return docs.withColumn(out, F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in arrays.pieces(batch.column(text)):
                some = batch.slice(p.first, p.rows)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(shared.value.score(_of_piece(p)))], [*batch.schema.names, out])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(out, DoubleType()))


def held_out(key: Column) -> Column:
    """Rows kept away from all training: crc32 of the id as text, modulo 3, is 1; null ids are not held out."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Training rows: one per row of `stats` with a quality label that is not held out; repeated labels are averaged to 0 or 1."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    return stats.where(~held_out(F.col("doc_id"))).join(marks, "doc_id").select("doc_id", "stats", "label")


def fit(stats: DataFrame, labels: DataFrame) -> Model | None:
    """A model from (doc_id, stats) and labels; a fifth of the training rows, by hash of the id, calibrates."""
    return train(materialise(labelled(stats, labels), "labelled"), F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of `docs`, trained on the labelled rows that are not held out.

    Null and empty texts get the score of their statistics. Repeated rows are scored alike.
    """
    stats = materialise(statistics(docs.select("doc_id", "text")), "stats")  # texts are read once
    model = fit(stats, labels)
    return score(stats, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
