"""Leak-free splits, folds, sampling and their gates.

Every shuffle is an order by a seeded hash of the row key, so membership is repeatable and does not
depend on partitioning. Exact sizes come from global positions (`running`), never from one sorted task.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialise import materialise
from ..plans.ordering import hash_order, running, sequential_fold
from .catalogue import GateError, must_be_empty


def tag(df: DataFrame, split: str | Column, dataset_type: str | Column) -> DataFrame:
    def col(v):
        return F.lit(v) if isinstance(v, str) else v

    return df.withColumns({"split": col(split), "dataset_type": col(dataset_type)})


def union_tagged(*dfs: DataFrame) -> DataFrame:
    """Stack frames with differing columns; missing ones become null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def locked_split(
    scenes: DataFrame, protected: DataFrame, key: str, positive_val: float | int, negative: Sequence[float | int], seed: int = 42,
    expected: dict[str, int] | None = None,
) -> DataFrame:
    """Protected positives stay test; the other annotated positives give `positive_val` rows to val and the
    rest to train; negatives are cut into train, val and the rest test. Positives with zero annotations
    (`zero_annotation`) and those that were never annotated (`positive_unannotated`, null count) are excluded.

    `scenes` has `key`, `has_solar`, `annotation_count`. Sizes are row counts or fractions (cut by int()). Errors: a
    protected key that is no annotated positive scene, fewer negatives than the counts ask for, and a dataset type
    whose size differs from `expected`.
    """
    names = protected.select(key).distinct().withColumn("__test", F.lit(1))
    fine = scenes.where((F.col("has_solar") == 1) & (F.col("annotation_count") > 0)).select(key)
    must_be_empty(names.select(key).join(fine, key, "left_anti"), "protected rows without annotations")
    df = scenes.join(names, key, "left")
    kind = (
        F.when((F.col("has_solar") == 1) & F.col("annotation_count").isNull(), "positive_unannotated")
        .when((F.col("has_solar") == 1) & (F.col("annotation_count") == 0), "zero_annotation")
        .when(F.col("__test") == 1, "protected").when(F.col("has_solar") == 1, "positive_annotated").otherwise("negative")
    )
    df = df.withColumn("__kind", kind).drop("__test")
    placed = running(df, hash_order(key, seed=seed), by=["__kind"], pos="__pos")
    n = df.groupBy("__kind").agg(F.count("*").alias("__n"))  # five rows
    sizes = {r["__kind"]: r["__n"] for r in n.collect()}
    wanted = sum(v for v in negative if not isinstance(v, float))
    if wanted > sizes.get("negative", 0):
        raise GateError(f"{wanted} negatives asked for, {sizes.get('negative', 0)} found")
    sizes["positive_annotated"] = sizes.get("positive_annotated", 0) + sizes.pop("protected", 0)
    wrong = {k: (v, sizes.get(k, 0)) for k, v in (expected or {}).items() if v != sizes.get(k, 0)}
    if wrong:
        raise GateError(f"sizes of dataset types (expected, found): {wrong}")
    placed = placed.join(F.broadcast(n), "__kind")

    def size(v: float | int) -> Column:
        return F.floor(F.col("__n") * F.lit(v)) if isinstance(v, float) else F.lit(v)

    pos, k = F.col("__pos"), F.col("__kind")
    split = (
        F.when(k.isin("zero_annotation", "positive_unannotated"), "excluded").when(k == "protected", "test")
        .when(k == "positive_annotated", F.when(pos <= size(positive_val), "val").otherwise("train"))
        .otherwise(F.when(pos <= size(negative[0]), "train").when(pos <= size(negative[0]) + size(negative[1]), "val").otherwise("test"))
    )
    return tag(placed, split, F.when(k == "protected", "positive_annotated").otherwise(k)).drop("__kind", "__pos", "__n")


def fraction_split(df: DataFrame, key: str, fractions: Sequence[float] = (0.70, 0.15), seed: int = 42) -> DataFrame:
    """Train/val/test by a seeded shuffle: int(n x fraction) rows each to train and val, the rest to test."""
    n = df.count()
    a = int(n * fractions[0])
    b = a + int(n * fractions[1])
    pos = F.col("__pos")
    return running(df, hash_order(key, seed=seed), pos="__pos").withColumn(
        "split", F.when(pos <= a, "train").when(pos <= b, "val").otherwise("test")
    ).drop("__pos")


#: odd number next to 2^31 over the golden ratio: its multiples modulo 2^31 spread evenly over every stretch of positions
SPREAD, STEP = 1 << 31, 1_327_217_885


def deal(groups: DataFrame, order: Sequence[Column], shares: Sequence[float], out: str) -> DataFrame:
    """Deal rows in a total `order` to the numbers 0.. in the given shares, evenly along the whole order.

    Position x step modulo 2^31 falls into the interval of one number, so any stretch of m neighbours holds
    m x share of each, but for an error that grows with log m. Positions come from `running`; nothing is decided in turn.
    """
    whole = float(sum(shares))
    if whole <= 0:
        raise ValueError("shares must have a positive sum")
    ends = [int(SPREAD * (sum(shares[: i + 1]) / whole)) for i in range(len(shares) - 1)]
    u = (F.col("__pos") % SPREAD) * STEP % SPREAD
    number = sum([(u >= e).cast("int") for e in ends], F.lit(0))
    return running(groups, order, pos="__pos").withColumn(out, number).drop("__pos")


def largest(groups: DataFrame, size: Column, group: str, seed: int, turns: int) -> tuple[DataFrame, DataFrame]:
    """The `turns` groups of the largest `size` (ties in seeded order) and the others."""
    if turns <= 0:
        return groups.limit(0), groups
    heavy = materialise(groups.orderBy(size.desc(), *hash_order(group, seed=seed)).limit(turns), "heavy")
    return heavy, groups.join(F.broadcast(heavy.select(group)), group, "left_anti")  # `turns` rows


def attach(df: DataFrame, heavy: DataFrame, light: DataFrame, group: str) -> DataFrame:
    """Rows of `df` with the columns decided for their group: the bounded list of heavy groups is broadcast, so a hot
    group is not shuffled to one task; the light ones, none of them hot, join by key. Rows without a group are left out."""
    names = [group, *[c for c in heavy.columns if c != group]]
    df = df.drop(*names[1:])
    return df.join(F.broadcast(heavy), group).select(*df.columns, *names[1:]).unionByName(df.join(light.select(names), group).select(*df.columns, *names[1:]))


def group_split(
    df: DataFrame, group: str, ratios: Sequence[float] = (0.70, 0.15, 0.15), seed: int = 830, chunk: int = 5_000, turns: int = 5_000
) -> DataFrame:
    """Whole groups to the split with the least load relative to its target, in seeded group order.

    The `turns` largest groups are decided one after the other in that way, so up to as many groups the split is the
    plain rule's. All others, each below 1/`turns` of the rows, are dealt at once by `deal`, ordered by size, in the shares of what
    the splits still lack.
    """
    names = ("train", "val", "test")
    counts = materialise(df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n")), "groups")
    total = counts.agg(F.sum("n")).first()[0] or 0
    target = [float(total) * r for r in ratios]

    def choose(state: Column, x: Column) -> Column:
        loads = [state[i] / F.lit(t) for i, t in enumerate(target)]
        best = F.least(*loads)
        return F.when(loads[0] == best, 0).when(loads[1] == best, 1).otherwise(2)

    def update(state: Column, x: Column, p: Column) -> Column:
        return F.transform(state, lambda v, i: v + F.when(i == p, x["n"]).otherwise(0))

    heavy, rest = largest(counts, F.col("n"), group, seed, turns)
    big = sequential_fold(heavy, hash_order(group, seed=seed), [group, "n"], [0, 0, 0], choose, update, "__s", chunk)
    loads = {r[0]: r[1] for r in big.groupBy("__s").agg(F.sum("n")).collect()}  # one row per split
    lack = [max(0.0, t - loads.get(i, 0)) for i, t in enumerate(target)]
    small = deal(rest, [F.col("n"), *hash_order(group, seed=seed)], lack if sum(lack) > 0 else ratios, "__s")

    def named(g: DataFrame) -> DataFrame:
        return g.select(group, F.element_at(F.array(*[F.lit(s) for s in names]), F.col("__s") + 1).alias("split"))

    return attach(df, named(big), named(small), group)


def group_split_hashed(df: DataFrame, group: str, ratios: Sequence[float] = (0.70, 0.15, 0.15), seed: int = 830, buckets: int = 10_000) -> DataFrame:
    """Whole groups to splits by a seeded hash bucket of the group: no shuffle and no order, sizes by expectation.

    The form for rows as they come, when not even the groups are to be counted.
    """
    bucket = F.conv(F.substring(hash_order(group, seed=seed)[0], 1, 8), 16, 10).cast("bigint") % buckets
    a, b = round(ratios[0] * buckets), round((ratios[0] + ratios[1]) * buckets)
    return df.withColumn("split", F.when(bucket < a, "train").when(bucket < b, "val").otherwise("test"))


def pilot_sample(eligible: DataFrame, protected: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """`n` random rows outside the protected list; an error when there are too few."""
    pool = eligible.join(protected.select(key).distinct(), key, "left_anti")
    picked = pool.orderBy(*hash_order(key, seed=seed)).limit(n)
    if picked.count() < n:
        raise GateError(f"fewer than {n} eligible rows")
    return picked


def fold_count(df: DataFrame, label: str, most: int) -> int:
    """min(most, smallest class); at least two or an error."""
    smallest = df.groupBy(label).count().agg(F.min("count")).first()[0] or 0
    k = min(most, int(smallest))
    if k < 2:
        raise GateError("not enough rows per class for cross-validation")
    return k


def stratified_kfold(df: DataFrame, label: str, key: str | Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Fold number per row: rows of a class are dealt out in seeded order of their key columns."""
    k = fold_count(df, label, k)
    keys = [key] if isinstance(key, str) else list(key)
    return running(df, hash_order(*keys, seed=seed), by=[label], pos="__pos").withColumn(
        "fold", ((F.col("__pos") - 1) % k).cast("int")
    ).drop("__pos")


def stratified_group_kfold(
    df: DataFrame, label: str, group: str, k: int = 4, seed: int = 42, chunk: int = 5_000, turns: int = 5_000
) -> DataFrame:
    """Folds that never split a group. The `turns` groups that hold the largest share of a class are decided in turn: the
    most uneven class counts first, each to the fold that leaves the class shares most even (ties: the smallest
    fold), so up to as many groups the folds are the plain rule's. All others are dealt at once by `deal`, ordered by their class counts, in the shares
    of what the folds still lack: groups with equal counts spread evenly, so a fold's share of a class differs by the rows of a few
    groups for each distinct list of counts."""
    df = df.where(F.col(group).isNotNull())
    totals = {r[0]: r[1] for r in df.groupBy(label).count().orderBy(label).collect()}  # one row per class
    classes = list(totals)
    c = len(classes)
    per = df.groupBy(group).agg(F.array(*[F.count_if(F.col(label).eqNullSafe(F.lit(v))) for v in classes]).alias("n"))
    per = materialise(per, "groups")
    k = min(k, min(totals.values(), default=0), per.count())
    if k < 2:
        raise GateError("not enough classes or groups for cross-validation")
    mean = F.aggregate("n", F.lit(0.0), lambda a, v: a + v) / c
    uneven = F.aggregate("n", F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
    per = per.withColumn("u", F.round(uneven, 6))

    def choose(state: Column, x: Column) -> Column:
        def cost(f: Column) -> Column:
            spread = F.lit(0.0)
            for ci, v in enumerate(classes):
                share = [(state[fi * c + ci] + F.when(f == fi, x["n"][ci]).otherwise(0)) / F.lit(float(totals[v])) for fi in range(k)]
                m = sum(share[1:], share[0]) / k
                dev = [(s - m) * (s - m) for s in share]
                spread = spread + F.sqrt(sum(dev[1:], dev[0]) / k)
            size = F.aggregate(F.slice(state, f * c + 1, c), F.lit(0).cast("bigint"), lambda a, v: a + v)
            return F.struct(F.round(spread / c, 12).alias("c"), size.alias("s"), f.alias("f"))

        return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), cost))["f"]

    def update(state: Column, x: Column, p: Column) -> Column:
        return F.transform(state, lambda v, i: v + F.when(F.floor(i / c) == p, x["n"][(i % c).cast("int")]).otherwise(0))

    shares = [F.col("n")[ci] / F.lit(float(totals[v])) for ci, v in enumerate(classes)]
    heavy, rest = largest(per, F.greatest(*shares) if c > 1 else shares[0], group, seed, turns)
    order = [-F.col("u"), *hash_order(group, seed=seed)]
    big = sequential_fold(heavy, order, [group, "n", "u"], [0] * (k * c), choose, update, "fold", chunk)
    loads = {r[0]: r[1:] for r in big.groupBy("fold").agg(*[F.sum(F.col("n")[ci]) for ci in range(c)]).collect()}  # one row per fold
    lack = [sum(max(0.0, 1 / k - loads.get(f, [0] * c)[ci] / totals[v]) for ci, v in enumerate(classes)) for f in range(k)]
    small = deal(rest, [F.col("n"), *hash_order(group, seed=seed)], lack if sum(lack) > 0 else [1] * k, "fold")
    return attach(df, big.select(group, "fold"), small.select(group, "fold"), group)


def replay_manifest(positives: DataFrame, negatives: DataFrame, hard: DataFrame, key: str = "filename") -> DataFrame:
    """Training list: positives, negatives and one more copy of each hard negative."""
    def part(df: DataFrame, source: str, replay: int) -> DataFrame:
        return df.select(F.col(key), F.lit(source).alias("source"), F.lit(replay).alias("replay"))

    return part(positives, "positive", 0).unionAll(part(negatives, "negative", 0)).unionAll(part(hard, "hard_negative_replay", 1))


def balanced_interleave(a: DataFrame, b: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """Even positions walk `a`, odd positions walk `b`, each wrapping round; length 2 x the larger by default."""
    na, nb = a.count(), b.count()
    length = 2 * max(na, nb) if n is None else n
    slots = a.sparkSession.range(length).withColumnRenamed("id", "position")
    half = F.floor(F.col("position") / 2)

    def walk(df: DataFrame, size: int, odd: int, domain: str) -> DataFrame:
        rows = running(df.select(key), [F.col(key)], pos="__pos").withColumn("__at", F.col("__pos") - 1)
        return slots.where(F.col("position") % 2 == odd).withColumn("__at", half % size).join(rows, "__at").select(
            "position", F.lit(domain).alias("domain"), key
        )

    return walk(a, na, 0, "a").unionAll(walk(b, nb, 1, "b"))


def seeded_shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A repeatable row order: adds `shuffle_pos`."""
    return running(df, hash_order(key, seed=seed), pos="shuffle_pos")


def overlap(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that occur in more than one split, in one pass; must be empty for a clean split."""
    return df.groupBy(key).agg(F.min(split).alias("first_split"), F.max(split).alias("last_split"), F.count("*").alias("n")).where(
        "first_split <> last_split"
    )


def coverage_gate(all_rows: DataFrame, splits: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows missing from the splits and rows the inventory does not know (multiset difference both ways)."""
    a, b = all_rows.select(key), splits.select(key)
    return a.exceptAll(b), b.exceptAll(a)


def leak_guard(mined: DataFrame, train: DataFrame, test: DataFrame, key: str = "filename") -> DataFrame:
    """Violations of a mined list: not in train, in test, or repeated."""
    not_train = mined.join(train.select(key).distinct(), key, "left_anti").select(key, F.lit("not_in_train").alias("violation"))
    in_test = mined.join(test.select(key).distinct(), key, "left_semi").select(key, F.lit("in_test").alias("violation"))
    twice = mined.groupBy(key).count().where("count > 1").select(key, F.lit("repeated").alias("violation"))
    return not_train.unionAll(in_test).unionAll(twice)


def assert_no_leak(mined: DataFrame, train: DataFrame, test: DataFrame, key: str = "filename") -> None:
    must_be_empty(leak_guard(mined, train, test, key), "leaking rows")


def split_summary(df: DataFrame, strip: str = "strip", category: str = "category", categories: Sequence[str] = ()) -> DataFrame:
    """Images, share, distinct strips and images per category for each split.

    Distinct strips are counted over (split, strip) pairs, so no task holds a split's strips.
    """
    per = df.groupBy("split", strip).agg(F.count("*").alias("n"), *[F.count_if(F.col(category) == c).alias(f"n{i}") for i, c in enumerate(categories)])
    out = per.groupBy("split").agg(F.sum("n").alias("images"), F.count("*").alias("strips"), *[F.sum(f"n{i}").alias(c) for i, c in enumerate(categories)])
    total = out.agg(F.sum("images").alias("__t"))  # one row
    return out.join(F.broadcast(total)).withColumn("percent", F.round(F.col("images") / F.col("__t") * 100.0, 4)).drop("__t")


def set_fingerprint(df: DataFrame, col: str, by: Sequence[str] = (), depth: int = 3) -> DataFrame:
    """(by, fingerprint, form): SHA-256 over the distinct ids of each group; nulls are left out.

    `depth` alone sets the form, never the number of ids. Depth 0, form `plain`, is the digest of the sorted,
    newline-joined ids; one task holds a group's whole list. Any other depth, form `tree-<depth>`, spreads
    the ids over 16^depth buckets by the first hex digits of their own hash and combines the bucket
    digests 16 at a time, so a task holds one bucket. Fingerprints of different forms never compare equal.
    """
    ids = df.select(*by, F.col(col).cast("string").alias("id")).where("id is not null").distinct()
    form = f"tree-{depth}" if depth else "plain"

    def digest(rows: DataFrame, bucket: Column, order: Column) -> DataFrame:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda s: s["v"]), "\n")
        return rows.groupBy(*by, bucket.alias("bucket")).agg(F.sha2(joined, 256).alias("digest"))

    level = digest(ids, F.substring(F.sha2("id", 256), 1, depth) if depth else F.lit(""), F.struct(F.col("id").alias("v")))
    for d in range(depth - 1, -1, -1):
        level = digest(level, F.substring("bucket", 1, d) if d else F.lit(""), F.struct(F.col("bucket").alias("b"), F.col("digest").alias("v")))
    return level.select(*by, F.col("digest").alias("fingerprint"), F.lit(form).alias("form"))
