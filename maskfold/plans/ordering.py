"""Global order without a single-task window.

`running` gives row positions and running sums or maxima in a total order. Rows are range
partitioned on the whole order key (ties included, so one hot value still splits), the partition
number is written down once, and only one summary row per partition is combined across partitions.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .materialise import materialise


def running(
    df: DataFrame,
    order: Sequence[Column],
    by: Sequence[str] = (),
    pos: str | None = "pos",
    sums: dict[str, str] | None = None,
    maxes: dict[str, str] | None = None,
) -> DataFrame:
    """Add `pos` (1-based), running sums and running maxima in `order` within `by`.

    `order` must be a total order; `sums` and `maxes` map an input column to the new column.
    """
    sums, maxes = sums or {}, maxes or {}
    keys = {f"__o{i}": c for i, c in enumerate(order)}
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumns(keys).repartitionByRange(parts, *by, *keys)
    placed = materialise(placed.withColumn("__pid", F.spark_partition_id()), "ordered")

    summary = placed.groupBy(*by, "__pid").agg(
        F.count("*").alias("__n"),
        *[F.sum(c).alias(f"__s_{o}") for c, o in sums.items()],
        *[F.max(c).alias(f"__m_{o}") for c, o in maxes.items()],
    )
    # at most one row per range partition and `by` value reaches this window
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = summary.select(
        *by,
        "__pid",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"),
        *[F.coalesce(F.sum(f"__s_{o}").over(before), F.lit(0)).alias(f"__s0_{o}") for o in sums.values()],
        *[F.max(f"__m_{o}").over(before).alias(f"__m0_{o}") for o in maxes.values()],
    )
    inside = Window.partitionBy(*by, "__pid").orderBy(*keys)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.join(offsets, [*by, "__pid"])
    new = {}
    if pos:
        new[pos] = F.col("__n0") + F.row_number().over(inside)
    for c, o in sums.items():
        new[o] = F.col(f"__s0_{o}") + F.sum(c).over(upto)
    for c, o in maxes.items():
        new[o] = F.greatest(F.col(f"__m0_{o}"), F.max(c).over(upto))
    return out.select(*df.columns, *[e.alias(n) for n, e in new.items()])


def _numbered(by: Sequence[str], flag: str):
    """Counts rows and set flags per `by` over the sorted rows of one partition, batch by batch."""

    def run(batches):
        last, n0, s0 = None, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            for c in by:
                codes = pc.dictionary_encode(b.column(c), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            first = tuple(b.column(c)[0].as_py() for c in by)
            if first != last:
                n0 = s0 = 0
            start = np.maximum.accumulate(np.where(new, np.arange(b.num_rows), 0))
            hits = b.column(flag).to_numpy(zero_copy_only=False).astype(np.int64)
            total = np.cumsum(hits)
            n = np.arange(b.num_rows) - start + 1 + np.where(start == 0, n0, 0)
            s = total - (total - hits)[start] + np.where(start == 0, s0, 0)
            last, n0, s0 = tuple(b.column(c)[-1].as_py() for c in by), int(n[-1]), int(s[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(s, pa.int64())], names=[*b.schema.names, "__n", "__s"])

    return run


def tally(df: DataFrame, order: Sequence[Column], flag: str, by: Sequence[str] = (), pos: str = "rank", hits: str = "tp_cum") -> DataFrame:
    """Add `pos` (1-based) and the running number `hits` of rows whose `flag` (0 or 1) is set, in the total order within `by`.

    Rows are shuffled once and counted while they are written in their order; what comes before a partition is one row for it.
    The partition is kept in `__pid` for `from_end`.
    """
    by = list(by)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order).withColumn("__pid", F.spark_partition_id())
    schema = StructType([*placed.schema.fields, StructField("__n", LongType()), StructField("__s", LongType())])
    placed = materialise(placed.mapInArrow(_numbered(by, flag), schema), "ordered")
    # one row per partition and `by` value
    ends = placed.groupBy(*by, "__pid").agg(F.max("__n").alias("__n1"), F.max("__s").alias("__s1"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, "__pid", *[F.coalesce(F.sum(f"__{c}1").over(before), F.lit(0)).alias(f"__{c}0") for c in "ns"])
    out = placed.join(materialise(ends, "ends"), [*by, "__pid"])
    return out.select(*df.columns, "__pid", (F.col("__n0") + F.col("__n")).alias(pos), (F.col("__s0") + F.col("__s")).alias(hits))


def from_end(tallied: DataFrame, value: str, name: str, by: Sequence[str] = (), pos: str = "rank") -> DataFrame:
    """The running maximum `name` of `value` from the last row to the first, of a frame by `tally`."""
    by = list(by)
    tops = tallied.groupBy(*by, "__pid").agg(F.max(value).alias("__top"))
    after = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.col("__pid").desc()).rowsBetween(Window.unboundedPreceding, -1)
    tops = materialise(tops.select(*by, "__pid", F.max("__top").over(after).alias("__after")), "tops")
    inside = Window.partitionBy(*by, "__pid").orderBy(F.col(pos).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = tallied.withColumn("__in", F.max(value).over(inside)).join(tops, [*by, "__pid"])
    return out.withColumn(name, F.greatest("__in", "__after")).drop("__in", "__after", "__pid")


#: a sketch places a percentile between the values this far to either side; what lies outside is only counted
NEAR, ACCURACY = 0.002, 10_000


def exact_percentiles(
    df: DataFrame, value: str, ps: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Linear-interpolation percentiles of `value` per `by`, exact at any group size.

    A sketch of fixed size brackets each percentile, all rows are counted against the brackets, and only values
    inside them are put in order. Should a count show that a bracket misses its percentile, all values are ordered.
    `df` is read several times, so it should be a written table. No group is held in one task.
    """
    by = list(by)
    known = df.select(*by, value).where(F.col(value).isNotNull())
    sides = [min(max(p + d, 0.0), 1.0) for p in ps.values() for d in (-NEAR, NEAR)]
    sketch = known.groupBy(*by).agg(F.percentile_approx(value, sides, ACCURACY).alias("__q"))
    brackets = F.array(*[F.struct(F.lit(n).alias("__p"), F.lit(float(p)).alias("__at"), F.get("__q", F.lit(2 * i)).alias("__l"), F.get("__q", F.lit(2 * i + 1)).alias("__u")) for i, (n, p) in enumerate(ps.items())])
    # a row per group, written so that the engine knows its size before it joins
    sketch = materialise(sketch.where("__q is not null").select(*by, brackets.alias("__b")), "sketch")
    placed = (known.join(sketch, by) if by else known.join(F.broadcast(sketch))).select(*by, value, F.inline("__b"))
    v = F.col(value)
    stats = placed.groupBy(*by, "__p").agg(
        F.count("*").alias("__tot"), F.count_if(v < F.col("__l")).alias("__n0"), F.count_if(v <= F.col("__u")).alias("__n1"), F.max("__at").alias("__at")
    )
    stats = stats.select(*by, "__p", "__n0", "__n1", ((F.col("__tot") - 1) * F.col("__at")).alias("__rank"))
    stats = materialise(stats, "stats")
    if stats.where("floor(__rank) < __n0 or ceil(__rank) >= __n1").isEmpty():
        counts = placed.where((v >= F.col("__l")) & (v <= F.col("__u")))
    else:
        counts, stats = placed, stats.withColumn("__n0", F.lit(0))
    counts = counts.groupBy(*by, "__p", value).agg(F.count("*").alias("__c"))
    cum = running(counts, [v], [*by, "__p"], pos=None, sums={"__c": "__cum"}).join(stats, [*by, "__p"])
    upto = F.col("__n0") + F.col("__cum")
    first = upto - F.col("__c")
    got = cum.groupBy(*by, "__p").agg(
        *[F.max(F.when((first <= rank) & (rank < upto), v)).alias(f"__{tag}") for tag, rank in (("lo", F.floor("__rank")), ("hi", F.ceil("__rank")))],
        F.max(F.col("__rank") - F.floor("__rank")).alias("__f"),
    )
    exact = F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__f")
    return got.groupBy(*by).agg(*[F.max(F.when(F.col("__p") == n, exact)).alias(n) for n in ps])


def sequential_fold(
    groups: DataFrame,
    order: Sequence[Column],
    fields: Sequence[str],
    zero: Sequence[int],
    choose: Callable[[Column, Column], Column],
    update: Callable[[Column, Column, Column], Column],
    out: str,
    chunk: int = 5_000,
) -> DataFrame:
    """Give each row of `groups` an integer that depends on the choices made for all earlier rows.

    The state is a short array of integers. Rows are taken in `order`, one chunk per job, and only
    the state (a handful of numbers) passes from one chunk to the next.
    """
    spark = groups.sparkSession
    placed = running(groups.select(*fields), order, pos="__pos")
    placed = materialise(placed.withColumn("__chunk", F.floor((F.col("__pos") - 1) / chunk).cast("int")), "fold")
    chunks = (placed.agg(F.max("__chunk")).first()[0] or 0) + 1
    item = placed.select("__pos", *fields).schema.simpleString()
    state, parts = list(zero), []
    for i in range(chunks):
        arr = F.array_sort(F.collect_list(F.struct("__pos", *fields)))
        start = F.struct(
            F.array(*[F.lit(int(v)).cast("bigint") for v in state]).alias("state"),
            F.array().cast(f"array<struct<item:{item},{out}:int>>").alias("done"),
        )

        def step(acc, x):
            picked = choose(acc["state"], x).cast("int")
            return bind(
                picked,
                lambda p: F.struct(
                    update(acc["state"], x, p).cast("array<bigint>").alias("state"),
                    F.concat(acc["done"], F.array(F.struct(x.alias("item"), p.alias(out)))).alias("done"),
                ),
            )

        folded = placed.where(F.col("__chunk") == i).agg(arr.alias("a")).select(
            F.aggregate("a", start, step).alias("r")
        )
        folded = materialise(folded, "fold")
        state = folded.select("r.state").first()[0]
        parts.append(folded.select(F.explode("r.done").alias("d")))
    all_parts = parts[0]
    for p in parts[1:]:
        all_parts = all_parts.unionAll(p)
    return all_parts.select(*[F.col(f"d.item.{f}").alias(f) for f in fields], F.col(f"d.{out}").alias(out))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times inside a higher-order expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hash_order(*cols: str, seed: int) -> list[Column]:
    """A seeded, repeatable shuffle order that any SQL engine can rebuild; the columns break hash ties."""
    return [F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols])), *map(F.col, cols)]
