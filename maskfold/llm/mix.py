"""Mix sources to target weights by Efraimidis-Spirakis sampling.

A source's word budget is its share of the whole, filled like water up to `max_epochs` of its size.
Whole epochs come first; the rest of a budget takes documents in the order of their exponential keys
-ln(u) / quality, prefix-summed within the source up to the budget. Documents are taken whole or not at all: in
place of the one on the border, the further document whose size is nearest to the missing words is taken, if that
brings the source nearer to its budget.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskfold.plans.materialise import materialise
from maskfold.plans.ordering import running

from . import text as T

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2


def uniform(seed: int, *cols: Column) -> Column:
    """A number in (0, 1) that any SQL engine can rebuild: 13 hex digits of an MD5."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) of a table (source, source_size) with one row per source.

    Sources are numbered by code point, null last; weights repeat. Budgets stop at `max_epochs` times
    the source's size and the excess is shared again by weight: with sources in the order of
    cap / weight, all up to some place are full and the others share the remainder at one level.
    The two windows see one row per source.
    """
    number = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (number % len(weights) + 1).cast("int"))
    s = sizes.withColumn("__w", w).withColumn("__cap", F.col("source_size") * float(max_epochs))
    by_fill = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").isNull(), F.col("source"))
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(after)
    s = s.withColumn("__level", level).withColumn("__full", F.col("__cap") <= F.col("__level") * F.col("__w"))
    # the level of the first source that is not full, the highest of theirs, holds for all that follow
    s = s.withColumn("__at", F.max(F.when(~F.col("__full"), F.col("__level"))).over(everything))
    return s.select("source", "source_size", F.when(F.col("__full"), F.col("__cap")).otherwise(F.col("__at") * F.col("__w")).alias("target"))


def sample(
    docs: DataFrame,
    quality: DataFrame | None = None,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    max_epochs: float = MAX_EPOCHS,
    seed: int = 42,
) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, more, taken, text_hash) for each row of `docs`.

    `copies` whole copies are taken, and one `more`; taken = (copies + more) * size. `quality`
    is (doc_id, weight) with one row per id; missing, null and non-positive weights count as 1.
    Null text has size 0 and is taken `copies` times, null source is a source of its own, repeated rows are rows of their own.
    Ties of the keys are broken by id and text, so reruns agree. An empty table gives no rows. Texts of any length are
    counted whole, in one pass; other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", "source", T.n_words(F.col("text")).alias("size"), F.xxhash64(text).alias("__t"))
    if quality is not None:
        base = base.join(quality.select("doc_id", F.col("weight").cast("double").alias("__q")), "doc_id", "left")
    else:
        base = base.withColumn("__q", F.lit(1.0))
    q = F.when(F.col("__q") > 0, F.col("__q")).otherwise(1.0)
    # texts are read once; everything below works on this narrow table
    base = materialise(base.select("doc_id", "source", "size", "__t", (-F.log(uniform(seed, F.col("doc_id"))) / q).alias("__key")), "sizes")

    goals = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    goals = materialise(goals, "targets")
    order = [F.col("source").isNull(), F.col("source"), F.col("__key"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("__t")]
    placed = running(base.select("doc_id", "source", "size", "__key", "__t"), order, pos=None, sums={"size": "__upto"})

    # words of all sources before this one, in the same order as the running sum
    first = Window.orderBy(F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    goals = goals.withColumn("__first", F.coalesce(F.sum("source_size").over(first), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goals = goals.withColumn("copies", epochs)
    rest = F.floor(F.col("target") + 0.5).cast("long") - F.col("copies") * F.col("source_size")
    goals = goals.withColumn("__rest", rest).withColumnRenamed("source", "__s")
    out = placed.join(goals, F.col("source").eqNullSafe(F.col("__s"))).withColumn("__upto", F.col("__upto") - F.col("__first"))
    out = materialise(out.drop("__s", "__first", "__key"), "placed")

    # what the prefix leaves of a source's rest, and the row behind it that fits there best
    gaps = out.groupBy("source", "__rest").agg((F.col("__rest") - F.coalesce(F.max(F.when(F.col("__upto") <= F.col("__rest"), F.col("__upto"))), F.lit(0))).alias("__gap"))
    # written, so that their size is known and small ones are joined without dealing the rows by source
    gaps = materialise(gaps.select(F.col("source").alias("__s"), "__gap").where("__gap > 0"), "gaps")
    behind = out.where("__upto > __rest and size > 0").join(gaps, F.col("source").eqNullSafe(F.col("__s")))
    best = behind.groupBy("__s", "__gap").agg(F.min(F.struct(F.abs(F.col("size") - F.col("__gap")).alias("off"), F.col("__upto").alias("upto"))).alias("b"))
    best = materialise(best.where("b.off < __gap").select("__s", F.col("b.upto").alias("__pick")), "picks")
    out = out.join(best, F.col("source").eqNullSafe(F.col("__s")), "left")
    more = ((F.col("__upto") <= F.col("__rest")) | F.coalesce(F.col("__upto") == F.col("__pick"), F.lit(False))) & (F.col("size") > 0)
    out = out.withColumn("more", more.cast("int"))
    taken = (F.col("copies") + F.col("more")) * F.col("size")
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", "more", taken.alias("taken"), F.col("__t").alias("text_hash"))


def label_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight) from quality labels: 2 for good, 0.5 for bad; contradicting rows count as good."""
    good = F.max(F.coalesce(F.col("quality"), F.lit(0)))
    return labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.when(good > 0, 2.0).otherwise(0.5).alias("weight"))


def mix(docs: DataFrame, quality: DataFrame | None = None, **options) -> DataFrame:
    """The mixed rows themselves, each an unchanged row of `docs`: `copies` times, and once more where `sample` says so.

    Null ids, sources and texts, repeated rows and empty tables are as in `sample`. Rows that share id, source and text
    are dealt their copies without regard to their other columns. Those may have any name and type; texts of any length
    pass whole.
    """
    picked = sample(docs, quality, **options)
    names = ["id_null", "id", "source_null", "source", "text_hash"]

    def ids(text_hash: Column) -> list[Column]:
        d, s = F.col("doc_id"), F.col("source")
        return [d.isNull().alias("id_null"), F.coalesce(d, F.lit(0)).alias("id"), s.isNull().alias("source_null"), F.coalesce(s, F.lit("")).alias("source"), text_hash.alias("text_hash")]

    takes = picked.select(*ids(F.col("text_hash")), "copies", "more").groupBy(*names).agg(
        F.count("*").alias("rows"), F.sum("more").alias("more"), F.max("copies").alias("copies")).where("copies > 0 or more > 0")
    takes = materialise(takes, "takes")
    wide = docs.select(F.struct("*").alias("row"), *ids(F.xxhash64(F.coalesce(F.col("text"), F.lit("")))))
    both = wide.join(takes, names)
    whole = both.where("more = 0 or more = rows").select("row", (F.col("copies") + (F.col("more") > 0).cast("int")).alias("times"))
    # of equal rows on the border only some are taken once more; such groups are few, but may be large
    split = takes.where("more > 0 and more < rows")
    if not split.isEmpty():
        some = materialise(wide.join(split, names).withColumn("n", F.monotonically_increasing_id()), "border")
        placed = running(some, [F.col("n")], by=names)
        whole = whole.unionAll(placed.select("row", (F.col("copies") + (F.col("pos") <= F.col("more")).cast("int")).alias("times")))
    return whole.select("row", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).select("row.*")
