"""Merkle manifest of a dataset by nested intervals of leaf ranks.

Leaves are ranked within their tree; every node covers an interval [lo, hi) of ranks, its parent the interval of
`fan` neighbours. A level bucket is `LEVELS` levels high: the nodes under one node of its top form a block of at
most fan ** LEVELS intervals, so a containment join is an equi join on (tree, block) that attaches all ancestors of a
block at once. Within a block siblings are what is left of the parent's interval without the own one.
A tree of N leaves takes ceil(log(N) / (LEVELS * log(fan))) such joins; each but the first works on a thousandth of
the nodes of the one before. The roots of all trees are the leaves of one more tree.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskfold.plans.materialise import materialise
from maskfold.plans.ordering import bind, running

LEVELS = 10
STEP = "struct<before:string,after:string>"


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 (lowercase hex) of all fields, each as UTF-8 byte count, `:` and value, or `-` for null."""

    def one(c: Column) -> Column:
        value = c.cast("string")
        return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*map(one, fields)), 256)


def _text(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda n: n["digest"]), "")


def _levels(kids: Column, height: Column, fan: int, levels: int) -> Column:
    """The nodes (lo, hi, digest) of each level of a block: its children, then `height` levels above them."""

    def parents(below: Column) -> Column:
        places = F.sequence(F.lit(0), F.ceil(F.size(below) / fan).cast("int") - 1)

        def parent(p: Column) -> Column:
            run = F.slice(below, p * fan + 1, F.lit(fan))
            return bind(run, lambda r: F.struct(
                F.element_at(r, 1)["lo"].alias("lo"), F.element_at(r, -1)["hi"].alias("hi"), F.sha2(_text(r), 256).alias("digest")))

        return F.transform(places, parent)

    steps = F.slice(F.sequence(F.lit(1), F.lit(levels)), F.lit(1), height)
    return F.aggregate(steps, F.array(kids), lambda acc, _: bind(F.element_at(acc, -1), lambda below: F.concat(acc, F.array(parents(below)))))


def _proof(levels: Column, place: Column, height: Column, fan: int) -> Column:
    """The siblings of child `place` of a block and of each of its ancestors below the top, as digests before and after it."""

    def step(level: Column, j: Column) -> Column:
        own = F.floor(place / F.pow(F.lit(fan), j)).cast("int")
        parent = own - own % fan  # where the parent's interval begins
        return F.struct(
            _text(F.slice(level, parent + 1, own - parent)).alias("before"),
            _text(F.slice(level, own + 2, parent + fan - 1 - own)).alias("after"),
        )

    return F.transform(F.slice(levels, F.lit(1), height), step)


def _grow(ranked: DataFrame, sizes: DataFrame, carry: Sequence[str], fan: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """(tree, *carry, root, proof) for each of `ranked` (tree, rank, digest, *carry), and the roots (tree, digest).

    `sizes` is (tree, n, height). Ranks count from 0 without gaps within a tree.
    """
    top = sizes.agg(F.max("height")).first()[0] or 0
    buckets = max(1, -(-top // levels))
    width = fan**levels
    nodes = ranked.select(
        "tree", F.col("rank").alias("at"), F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", F.struct(*carry).alias("row")
    )
    tiers = []
    plain = F.transform("kids", lambda k: F.struct(k["lo"].alias("lo"), k["hi"].alias("hi"), k["digest"].alias("digest")))
    all_levels = _levels(plain, F.col("height"), fan, levels)
    for b in range(buckets):
        kid = F.struct("at", "lo", "hi", "digest", *(["row"] if b == 0 else []))
        block = nodes.groupBy("tree", F.floor(F.col("at") / width).alias("block")).agg(F.sort_array(F.collect_list(kid)).alias("kids"))
        # a bucket of a tree has as many levels as are left of its height
        left = F.greatest(F.lit(0), F.least(F.lit(levels), F.col("height") - b * levels)).cast("int")
        tiers.append(materialise(block.join(sizes, "tree").select("tree", "block", "kids", left.alias("height")), "blocks"))
        head = F.element_at(F.element_at(all_levels, -1), 1)
        nodes = materialise(tiers[-1].select("tree", F.col("block").alias("at"), head.alias("head")).select("tree", "at", "head.*"), "nodes")
    roots = nodes.select("tree", "digest")

    # downwards: a block's node is a child of a block of the bucket above, whose interval contains it
    above = nodes.select(
        "tree", F.col("at").alias("block"), F.col("lo").alias("first"), F.col("hi").alias("upto"),
        F.array().cast(f"array<{STEP}>").alias("up"), F.col("digest").alias("root"),
    )
    for b in reversed(range(buckets)):
        tier = tiers[b].join(above, ["tree", "block"]).where("kids[0].lo >= first and kids[size(kids) - 1].hi <= upto")

        def proofs(lv: Column) -> Column:
            return F.transform("kids", lambda k, i: F.struct(
                k.alias("kid"), F.concat(_proof(lv, i, F.col("height"), fan), F.col("up")).alias("proof")))

        out = tier.select("tree", "root", F.inline(bind(all_levels, proofs)))
        if b:
            above = materialise(out.select(
                "tree", F.col("kid.at").alias("block"), F.col("kid.lo").alias("first"), F.col("kid.hi").alias("upto"), F.col("proof").alias("up"), "root"), "above")
    return out.select("tree", *[F.col(f"kid.row.{c}").alias(c) for c in carry], "root", "proof"), roots


def manifest(rows: DataFrame, tree: str = "lang", order: Sequence[str] = ("doc_id",), digest: str = "leaf", fan: int = 2, levels: int = LEVELS) -> DataFrame:
    """The columns of `rows` and `subroot`, `root` and `proof` of each row; columns of these names are replaced.

    Rows of equal `tree` (a string; null is a tree of its own and comes first, then by UTF-8 bytes) are leaves by `order`,
    null first, ties by digest and then by a hash of all columns; repeated rows are leaves of their own. Runs of `fan` nodes
    become the hash of their digests' hex texts until one remains, the subroot (a lone leaf itself); subroots likewise give the root.
    `proof` lists per level, leaf first, the digests of the run's others before and after the own one, through the subroot to the root.
    A null digest counts as empty. An empty table gives no rows. Texts are not needed here, only their digests; map columns cannot be hashed.
    """
    carry = [c for c in rows.columns if c not in ("subroot", "root", "proof")]
    heights = lambda n: sum((n > fan**h).cast("int") for h in range(63) if fan**h < 2**62)
    own = [f"c{i}" for i in range(len(carry))]
    named = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit(""))
    base = rows.select(named.alias("tree"), F.coalesce(F.col(digest), F.lit("")).alias("digest"), *[F.col(c).alias(n) for c, n in zip(carry, own, strict=True)])
    keys = [F.col(own[carry.index(c)]) for c in order]
    by = [x for c in keys for x in (c.isNotNull(), c)] + [F.col("digest"), F.xxhash64(*own)]
    placed = running(base, by, by=["tree"], pos="rank").withColumn("rank", F.col("rank") - 1)
    placed = materialise(placed, "leaves")
    sizes = placed.groupBy("tree").agg(F.count("*").alias("n"))
    sizes = materialise(sizes.withColumn("height", heights(F.col("n"))), "trees")
    grown, roots = _grow(placed, sizes, own, fan, levels)

    # the same for the subroots, in one tree
    ordered = running(roots.withColumnRenamed("tree", "own"), [F.col("own")], pos="rank")
    ordered = materialise(ordered.select(F.lit("").alias("tree"), "own", "digest", (F.col("rank") - 1).alias("rank")), "subroots")
    count = ordered.groupBy("tree").agg(F.count("*").alias("n")).withColumn("height", heights(F.col("n")))
    over, _ = _grow(ordered, materialise(count, "trees"), ["own"], fan, levels)
    over = materialise(over.select(F.col("own").alias("tree"), F.col("root").alias("all"), F.col("proof").alias("more")), "above")
    cols = [F.col(n).alias(c) for c, n in zip(carry, own, strict=True)]
    return grown.join(over, "tree").select(*cols, F.col("root").alias("subroot"), F.col("all").alias("root"), F.concat("proof", "more").alias("proof"))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf gives with the siblings of a proof."""
    return F.aggregate(proof, leaf, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of the siblings' hex texts, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)
