"""Near-duplicate vectors by a forest of random-projection trees with spill.

All nodes of one level of a tree share a random direction; a node splits its vectors at the median of their
projections and those near the median go to both sides. Equal vectors are folded first. The splits of the upper
levels are fitted on a bounded sample; nodes that are still too large are split level by level with medians
computed by Spark, so trees get deeper as the table grows. Pairs are compared within leaves in double precision;
a pair met in several leaves is counted in the first of them only, so no pair is ever written down: a leaf
returns link counts per vector and a spanning forest.

Splits would tear dense clusters of unequal vectors apart, so these are taken out first: a ball around a pivot with
many neighbours in the sample has the vectors within the threshold angle as its core, and whatever links with one of them
lies within twice that angle. Core vectors meet all of these and enter no tree. A tree's node in which a quarter of
all pairs link is not split. Leaves that stay large are compared chunk by chunk in many tasks.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskfold.plans.materialise import materialise

from .components import components

THRESHOLD = 0.9
TREES = 8
LEAF = 400
SAMPLE = 20_000
SAMPLE_LEAF = 120  # sampled vectors a node needs to be split on the sample
SPILL = 0.05  # share of a node's vectors on each side of the median that go to both sides
SEED = 11
CORE = 8  # sampled neighbours that a pivot of a ball needs at least
BALL = 4  # a ball holds at most so many times its core in the sample, else its vectors stay in the trees
DENSE = 0.25  # share of linked pairs from which a node is not split
CHUNK = 4_000  # vectors of a large leaf that a task takes from each side


def directions(dims: int, tree: int, level: int) -> np.ndarray:
    g = np.random.default_rng([SEED, tree, level]).normal(size=dims)
    return g / np.linalg.norm(g)


def _wide(threshold: float) -> float:
    """The cosine of twice the threshold angle, a little wider for rounding."""
    return float(np.cos(min(np.pi, 2 * np.arccos(np.clip(threshold, -1, 1))))) - 1e-9


def _pivots(sample: np.ndarray, threshold: float, least: int, block: int = 1000) -> np.ndarray:
    """Sampled vectors whose balls hold the dense clusters, those with most neighbours first."""
    x = sample.astype(np.float32)
    near = np.concatenate([np.zeros(0, np.int64), *[(x[a : a + block] @ x.T >= threshold).sum(1) for a in range(0, len(x), block)]])
    free = np.ones(len(x), bool)
    found = []
    for i in np.argsort(-near, kind="stable"):
        if near[i] < least:
            break
        if free[i]:
            c = x @ x[i]
            core = free & (c >= threshold)
            if core.sum() >= least and (c >= _wide(threshold)).sum() <= BALL * core.sum():
                found.append(i)
                free &= ~core
    return sample[np.array(found, np.int64)]


def _share(x: np.ndarray, threshold: float) -> float:
    """The share of linked pairs among the first 256 of `x`."""
    x = x[:256]
    return float((np.count_nonzero(x @ x.T >= threshold) - len(x)) / max(1, len(x) * (len(x) - 1)))


def _fit(sample: np.ndarray, trees: int, leaf: int, threshold: float = THRESHOLD) -> list[dict[str, tuple[float, float]]]:
    """Per tree: node (a string of 0 and 1) -> the projections between which vectors go to both sides."""
    forest = []
    for t in range(trees):
        nodes: dict[str, tuple[float, float]] = {}
        todo = [("", np.arange(len(sample)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) < 2 * leaf or _share(sample[rows], threshold) >= DENSE:
                continue
            p = sample[rows] @ directions(sample.shape[1], t, len(node))
            lo, hi = np.quantile(p, [0.5 - SPILL, 0.5 + SPILL])
            left, right = rows[p <= hi], rows[p >= lo]
            if len(left) == len(rows) or len(right) == len(rows):
                continue
            nodes[node] = (float(lo), float(hi))
            todo += [(node + "0", left), (node + "1", right)]
        forest.append(nodes)
    return forest


def _route(x: np.ndarray, nodes: dict[str, tuple[float, float]], tree: int) -> Iterator[tuple[str, np.ndarray]]:
    todo = [("", np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        if node not in nodes:
            yield node, rows
            continue
        lo, hi = nodes[node]
        p = x[rows] @ directions(x.shape[1], tree, len(node))
        todo += [(node + "0", rows[p <= hi]), (node + "1", rows[p >= lo])]


def valid(vectors: DataFrame, key: str, value: str) -> DataFrame:
    """(key, v, dims) with unit vectors in double precision of the rows that can link at all."""
    v = F.transform(F.col(value), lambda x: x.cast("double"))
    rows = vectors.select(F.col(key).alias("id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.withColumn("top", F.array_max(F.transform("v", F.abs))).where("top > 0")
    # first by the largest component, so that squares neither overflow nor vanish
    rows = rows.withColumn("v", F.transform("v", lambda x: x / F.col("top")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return rows.withColumn("norm", norm).select("id", F.transform("v", lambda x: x / F.col("norm") + F.lit(0.0)).alias("v"), F.size("v").alias("dims"))


def _array(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _compare(threshold: float, block: int = 512):
    """Leaf table (rep, n, v, leaves, core, chunk) -> (a, b, links): link counts in b = null rows, forest edges else.

    Of a leaf in chunks, a task compares one chunk with itself or with another one. Pairs without a core vector are left out.
    """

    def run(key: tuple, t: pa.Table) -> pa.Table:
        here, dims, one, two = (key[0].as_py(), key[1].as_py()), key[2].as_py(), key[3].as_py(), key[4].as_py()
        t = t.sort_by([("chunk", "ascending"), ("core", "descending")])
        x = _array(t.column("v"), dims)
        rep = t.column("rep").to_numpy()
        mult = t.column("n").to_numpy()
        core = t.column("core").to_numpy(zero_copy_only=False)
        m = len(rep)
        first = m if one == two else int((t.column("chunk").to_numpy() == one).sum())
        root = np.arange(m)
        count = np.zeros(m, np.int64)
        edges: list[tuple[int, int]] = []
        # the leaves before this one that hold a vector, and those of them that compare it with all others
        earlier, fully = [], []
        for own in t.column("leaves").to_pylist():
            places = [s for s in map(_place, own) if s[:2] < here]
            earlier.append(frozenset(s[:2] for s in places))
            fully.append(frozenset(s[:2] for s in places if s[2]))

        def met(a: slice, b: slice) -> np.ndarray:
            """Which pairs of two blocks an earlier leaf has compared."""
            names = sorted(frozenset().union(*earlier[a]) & frozenset().union(*earlier[b]))
            got = np.zeros((a.stop - a.start, b.stop - b.start), bool)
            for k in range(0, len(names), 4096):
                at = {s: i for i, s in enumerate(names[k : k + 4096])}

                def flags(sets: list[frozenset], at: dict = at) -> np.ndarray:
                    out = np.zeros((len(sets), len(at)), np.float32)
                    for i, own in enumerate(sets):
                        out[i, [at[s] for s in own if s in at]] = 1
                    return out

                got |= (flags(earlier[a]) @ flags(fully[b]).T + flags(fully[a]) @ flags(earlier[b]).T) > 0
            return got

        for a0 in range(0, first, block):
            a = slice(a0, min(first, a0 + block))
            for b0 in range(a0 if one == two else first, m, block):
                b = slice(b0, min(m, b0 + block))
                if not (core[a].any() or core[b].any()):
                    continue
                close = x[a] @ x[b].T >= threshold
                close &= core[a, None] | core[None, b]
                if a0 == b0:
                    close = np.triu(close, 1)
                i, j = np.nonzero(close)
                if len(i) > block:
                    close &= ~met(a, b)
                else:
                    for p, q in zip(i.tolist(), j.tolist(), strict=True):
                        p_, q_ = p + a0, q + b0
                        close[p, q] = earlier[p_].isdisjoint(fully[q_]) and fully[p_].isdisjoint(earlier[q_])
                count[a] += close @ mult[b]
                count[b] += close.T @ mult[a]
                for p in np.flatnonzero(close.any(1)).tolist():
                    js = b0 + np.flatnonzero(close[p])
                    old, at = np.unique(root[js], return_index=True)
                    other = old != root[a0 + p]
                    if other.any():
                        edges += [(a0 + p, int(j)) for j in js[at[other]]]
                        root[np.isin(root, old[other])] = root[a0 + p]
        hit = np.flatnonzero(count)
        e = np.array(edges, np.int64).reshape(-1, 2)
        return pa.table({
            "a": pa.array(np.concatenate([rep[hit], rep[e[:, 0]]])),
            "b": pa.array([None] * len(hit) + rep[e[:, 1]].tolist(), pa.int64()),
            "links": pa.array(np.concatenate([count[hit], np.zeros(len(e), np.int64)])),
        })

    return run


def _place(leaf: str) -> tuple[int, str, bool]:
    """(tree, name, core) of a written leaf. Balls are leaves of tree -1, in which the core is written with a `+`."""
    tree, name = leaf.split(":")
    return int(tree), name.removesuffix("+"), tree != "-1" or name.endswith("+")


def near_duplicates(
    vectors: DataFrame,
    key: str = "vec_id",
    value: str = "embedding",
    threshold: float = THRESHOLD,
    trees: int = TREES,
    leaf: int = LEAF,
    sample: int = SAMPLE,
) -> DataFrame:
    """(key, n_links, component_id, kept) for each row of `vectors`.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors
    of different length. Equal vectors (the same direction to the last bit) always link. Rows of a repeated id count as
    vectors of their own; a null id gets links but names no component. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = materialise(valid(vectors, key, value), "vectors")
    # fold equal vectors; `node` numbers the folded ones by their bytes
    node = F.xxhash64("v", "dims")
    classes = materialise(rows.groupBy("v", "dims").agg(F.count("*").alias("n"), F.min("id").alias("least")).withColumn("rep", node), "classes")

    # upper levels: fitted on a bounded sample of folded vectors, per length
    forests: dict[int, tuple[np.ndarray, list]] = {}
    for r in classes.groupBy("dims").count().orderBy(F.desc("count")).limit(8).collect():
        taken = classes.where(F.col("dims") == r["dims"]).orderBy(F.xxhash64("rep")).limit(sample).select("v").toArrow()
        x, rate = _array(taken.column("v"), r["dims"]), taken.num_rows / max(1, r["count"])
        balls = _pivots(x, threshold, max(CORE, math.ceil(leaf * rate)))
        rest = x[(x @ balls.T < threshold).all(1)]
        forests[r["dims"]] = balls, _fit(rest, trees, max(SAMPLE_LEAF, min(leaf, int(leaf * rate))), threshold)
    shared = spark.sparkContext.broadcast(forests)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            names: list[list[str]] = [[] for _ in range(batch.num_rows)]
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = _array(batch.column("v").take(pa.array(at)), int(d))
                balls, forest = shared.value.get(int(d), (x[:0], [{}] * trees))
                if len(balls):
                    near = x @ balls.T
                    best = near.argmax(1)
                    inner = near[np.arange(len(x)), best] >= threshold
                    for i, k in zip(*np.nonzero(near >= _wide(threshold)), strict=True):
                        names[at[i]].append(f"-1:{k}={'+' if inner[i] and best[i] == k else ''}")
                    at, x = at[~inner], x[~inner]
                for t in range(trees):
                    for leaf_name, own in _route(x, forest[t], t):
                        for i in own:
                            names[at[i]].append(f"{t}:{leaf_name}")
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("n"), batch.column("dims"), batch.column("v"), pa.array(names, pa.list_(pa.string()))], ["rep", "n", "dims", "v", "leaves"])

    placed = classes.select("rep", "n", "dims", "v").mapInArrow(route, "rep long, n long, dims int, v array<double>, leaves array<string>")
    placed = materialise(placed, "placed")
    placed = _deepen(placed, 2 * leaf, threshold=threshold)

    split = F.split("leaf", ":")
    per_leaf = placed.select("rep", "n", "dims", "v", "leaves", F.explode("leaves").alias("leaf"))
    tree, core = F.element_at(split, 1).cast("int"), F.endswith("leaf", F.lit("+"))
    per_leaf = per_leaf.select("rep", "n", "v", "leaves", tree.alias("tree"), F.rtrim(F.element_at(split, 2), F.lit("+")).alias("leaf"), "dims", ((tree >= 0) | core).alias("core"))
    # only balls and dense leaves are that large: few, and each stands for thousands of vectors
    large = per_leaf.groupBy("tree", "leaf", "dims").count().where(F.col("count") > CHUNK)
    large = materialise(large.select("tree", "leaf", "dims", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")), "large")
    per_leaf = per_leaf.join(F.broadcast(large), ["tree", "leaf", "dims"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    per_leaf = per_leaf.withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(SEED)), F.col("chunks")).cast("int"))
    per_leaf = per_leaf.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    per_leaf = per_leaf.withColumns({"one": F.least("chunk", "other"), "two": F.greatest("chunk", "other")}).drop("other", "chunks")
    met = per_leaf.groupBy("tree", "leaf", "dims", "one", "two").applyInArrow(_compare(threshold), "a long, b long, links long")
    met = materialise(met, "met")

    links = met.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("other"))
    joined = components(met.where("b is not null"), "a", "b")
    named = classes.select("rep", "n", "least").join(joined.withColumnRenamed("node", "rep"), "rep", "left").join(links, "rep", "left")
    named = named.withColumn("component", F.coalesce("component", "rep"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("rep", (F.coalesce("other", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    of = rows.select("id", node.alias("rep")).join(named, "rep").select("id", "n_links", "component_id")
    # rows that can't link, and all others, by one narrow join
    every = vectors.select(F.col(key).alias("id"))
    alone = every.exceptAll(of.select("id")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = of.unionByName(alone)
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _deepen(placed: DataFrame, limit: int, levels: int = 40, threshold: float = THRESHOLD) -> DataFrame:
    """Split leaves of more than `limit` vectors, one level of all trees a round, at medians that Spark computes.

    A leaf whose projections are all equal, or in which a quarter of all pairs link, stays as it is; it is compared in chunks.
    """

    def dense(key: tuple, t: pa.Table) -> pa.Table:
        share = _share(_array(t.column("v"), key[0].as_py()), threshold)
        return pa.table({"dims": pa.array([key[0].as_py()], pa.int32()), "leaf": [key[1].as_py()], "dense": [share >= DENSE]})

    for _ in range(levels):
        sizes = placed.select("dims", F.explode("leaves").alias("leaf")).groupBy("dims", "leaf").count().where(F.col("count") > limit)
        big = materialise(sizes.where(~F.contains("leaf", F.lit("="))), "big")
        if not big.limit(1).count():
            break

        @F.pandas_udf("array<struct<leaf:string,p:double>>")
        def projections(v: pd.Series, leaves: pd.Series) -> pd.Series:
            out = []
            for x, own in zip(v, leaves, strict=True):
                ps = []
                for s in own:
                    t, name = s.split(":")
                    ps.append({"leaf": s, "p": float(x @ directions(len(x), int(t), len(name))) if "=" not in name else 0.0})
                out.append(ps)
            return pd.Series(out)

        flat = placed.select("rep", "dims", F.explode(projections("v", "leaves")).alias("x")).select("rep", "dims", "x.leaf", "x.p")
        flat = materialise(flat.join(big, ["dims", "leaf"]), "flat")
        few = flat.where(F.pmod(F.xxhash64("rep", F.lit(SEED)), F.col("count")) < 256).select("rep", "dims", "leaf").join(placed.select("rep", "v"), "rep")
        whole = few.groupBy("dims", "leaf").applyInArrow(dense, "dims int, leaf string, dense boolean")
        cuts = flat.groupBy("dims", "leaf").agg(F.percentile_approx("p", [0.5 - SPILL, 0.5 + SPILL], 1000).alias("q"), F.min("p").alias("lo"), F.max("p").alias("hi"))
        go = flat.join(cuts.join(whole, ["dims", "leaf"], "left"), ["dims", "leaf"])
        stuck = (F.col("q")[1] >= F.col("hi")) | (F.col("q")[0] <= F.col("lo")) | F.coalesce("dense", F.lit(False))
        left, right = F.col("p") <= F.col("q")[1], F.col("p") >= F.col("q")[0]
        to = F.when(stuck, F.array(F.concat("leaf", F.lit("=")))).otherwise(
            F.concat(F.when(left, F.array(F.concat("leaf", F.lit("0")))).otherwise(F.array().cast("array<string>")), F.when(right, F.array(F.concat("leaf", F.lit("1")))).otherwise(F.array().cast("array<string>")))
        )
        moved = go.select("rep", "leaf", to.alias("to")).groupBy("rep").agg(F.collect_list("leaf").alias("old"), F.flatten(F.collect_list("to")).alias("new"))
        placed = placed.join(moved, "rep", "left").select(
            "rep", "n", "dims", "v",
            F.when(F.col("old").isNull(), F.col("leaves")).otherwise(F.concat(F.array_except("leaves", "old"), F.col("new"))).alias("leaves"),
        )
        placed = materialise(placed, "placed")
    return placed
