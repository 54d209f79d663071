"""Cross-entropy difference of two word bigram models.

The target model is counted over marked texts, the background model over all texts; both use the words seen at
least `min_count` times in the background as their vocabulary and the same smoothing. A text is scored with its
own counts taken out of both models. The score is the mean over tokens of target loss minus background loss: the
lower, the closer to the target. Counts of the whole corpus are added up and looked up by `exchange`.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskfold.plans.materialise import materialise

from . import arrays, exchange
from .text import n_words

MIN_COUNT = 3
PRIOR = 2_000.0  # tokens of background unigrams in each unigram model
BACK = 5.0  # tokens of the unigram model in each bigram context
_BEGIN = np.uint64(0x5BD1E995)
_PAIR = np.uint64(0x2545F4914F6CDD1D)


def _items(texts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows, their bigram hashes (a row's first with the begin mark) and the begin mark at the
    end; and the number of words of each row."""
    words, pairs, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for p in arrays.pieces(texts.column("text")):
        before = np.empty_like(p.hash)
        before[1:] = p.hash[:-1]
        before[p.bounds[:-1][np.diff(p.bounds) > 0]] = _BEGIN
        words.append(p.hash)
        pairs.append(arrays.mix(before * np.uint64(3) + p.hash) ^ _PAIR)
        sizes.append(np.diff(p.bounds))
    return np.concatenate([*words, *pairs, np.array([_BEGIN], np.uint64)]), np.concatenate(sizes)


def _loss(uni: np.ndarray, ctx: np.ndarray, pair: np.ndarray, q: np.ndarray, total: float) -> np.ndarray:
    """-ln P(word | word before) of each token, from counts of one model and the background share q of the word."""
    p = (uni + PRIOR * q) / (total + PRIOR)
    return -np.log((pair + BACK * p) / (ctx + BACK))


SCORES = "id long, n_tokens long, n_known long, ce_target double, ce_background double, score double"


def _own(x: np.ndarray) -> np.ndarray:
    """How often each element occurs in x."""
    _, back, n = np.unique(x, return_inverse=True, return_counts=True)
    return n[back].astype(float)


def _score(targets: list[bool], sizes: np.ndarray, place: np.ndarray, counts: np.ndarray, totals: tuple[float, float], min_count: int) -> list[tuple]:
    """Rows of SCORES without the id. `counts` are (target, background) of the batch's items in sending order."""
    rows, at, words = [], 0, int(sizes.sum())
    for m, mine in zip(sizes.tolist(), targets, strict=True):
        if not m:
            rows.append((0, 0, 0.0, 0.0, 0.0))
            continue
        w, pair = place[at : at + m], place[words + at : words + at + m]
        at += m
        context = np.concatenate([place[-1:], w[:-1]])
        known = counts[w, 1] >= min_count
        own_w, own_pair = _own(w), _own(pair)
        own_context = np.concatenate([[1.0], own_w[:-1]])  # as a word before another
        share = np.maximum(counts[w, 1] - own_w, 0.5) / max(totals[1] - m, 1.0)
        mean = []
        for model, total in enumerate(totals):
            out = 1.0 if model == 1 or mine else 0.0
            uni, ctx, both = (np.maximum(counts[x, model] - out * o, 0.0) for x, o in ((w, own_w), (context, own_context), (pair, own_pair)))
            loss = _loss(uni, ctx, both, share, max(total - out * m, 1.0))[known]
            mean.append(float(loss.sum()) / len(loss) if len(loss) else 0.0)
        rows.append((m, int(known.sum()), *mean, mean[0] - mean[1]))
    return rows


def score(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """(key, n_tokens, n_known, ce_target, ce_background, score) for each row of `docs`.

    `target` holds the keys of the target texts. Words outside the shared vocabulary cost both models the same and
    are left out of the mean; a text without known words (null and empty ones, too) scores 0. Repeated
    rows count as often as they occur and each takes out one copy. Null keys are background. An empty table gives no rows.
    Texts of any length are scored whole, one at a time; counts of the corpus are 64 bits wide. Other columns are ignored.
    """
    kind = dict(docs.dtypes)[key]
    marks = target.select(F.col(key).alias("id")).where("id is not null").distinct().withColumn("__t", F.lit(True))
    size = docs.select(F.col(key).alias("id"), n_words(F.col(text)).alias("n"), F.octet_length(F.col(text)).alias("b"), F.xxhash64(key, text).alias("h"))
    size = materialise(size.join(marks, "id", "left"), "sizes")
    t, n, b, rows = size.agg(F.sum(F.when(F.col("__t"), F.col("n"))), F.sum("n"), F.sum("b"), F.count("*")).first()
    totals = float(t or 0), float(n or 0)
    layout = exchange.Layout.of(int(b or 0) + 100 * rows, 2 * int(n or 0), 5)

    base = docs.select(exchange.batch_of(layout, key, text).alias("batch"), F.col(key).alias("id"), F.col(text).alias("text"))
    chosen = size.where("__t").select("id", F.pmod("h", F.lit(layout.batches)).cast("long").alias("batch")).distinct()
    none = F.lit(None)
    chosen = chosen.select("batch", F.lit(-1).cast("long").alias("bucket"), none.cast("binary").alias("answer"), F.col("id").alias("mark"))

    def ordered(t: pa.Table, marked: pa.Table) -> pa.Table:
        t = t.sort_by([("id", "ascending"), ("text", "ascending")])
        mine = pc.is_in(t.column("id"), value_set=marked.column("mark").combine_chunks() if marked.num_rows else pa.array([], t.schema.field("id").type))
        return t.append_column("target", mine)

    def out(key_: tuple, t: pa.Table, m: pa.Table) -> pa.Table:
        t = ordered(t, m)
        items, sizes = _items(t)
        mine = np.array(t.column("target").to_pylist(), float)
        weights = np.ones((len(items), 2))
        weights[:-1, 0] = np.tile(np.repeat(mine, sizes), 2)
        weights[-1] = mine.sum(), t.num_rows  # the begin mark counts once per row
        return exchange.send(layout, key_[0].as_py(), items, weights)

    def back(key_: tuple, t: pa.Table, r: pa.Table) -> pa.Table:
        told = pc.greater_equal(r.column("bucket"), 0)
        t = ordered(t, r.filter(pc.invert(told)))
        items, sizes = _items(t)
        _, _, place = layout.ordered(items)
        counts = exchange.answers(r.filter(told), "<u8", 2).astype(float)
        got = _score(t.column("target").to_pylist(), sizes, place, counts, totals, min_count)
        cols = list(zip(*got, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        names = ["n_tokens", "n_known", "ce_target", "ce_background", "score"]
        return pa.table({"id": t.column("id")} | {k: pa.array(list(c), kind_) for k, c, kind_ in zip(names, cols, kinds, strict=True)})

    sent = base.groupBy("batch").cogroup(chosen.groupBy("batch")).applyInArrow(out, exchange.SENT)
    told = sent.groupBy("bucket").applyInArrow(exchange.answer(layout, 2, lambda total: total.astype("<u8")), exchange.ANSWER)
    both = told.select("batch", "bucket", "answer", none.cast(kind).alias("mark")).unionByName(chosen)
    scored = base.groupBy("batch").cogroup(both.groupBy("batch")).applyInArrow(back, SCORES.replace("id long", f"id {kind}"))
    return scored.withColumnRenamed("id", key)
