"""Connected components by randomised contraction.

Each round every node moves to the node with the smallest salted hash within two steps and the graph is rewritten on
the chosen nodes. A star shrinks to a point in one round and a constant share of the nodes goes away whatever the
shape of the graph, chains included, so the number of rounds grows with the logarithm of its size at most.
Maps are combined backwards and the smallest node names the component. Every round is a written table.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskfold.plans.materialise import materialise

ROWS_A_FILE = 200_000


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for each node of an edge that is not a loop; `component` is the smallest node reachable.

    Nulls and loops are ignored, repeated and reversed edges count once, an empty table gives no rows.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    e = materialise(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    kind = dict(e.dtypes)["u"]
    maps: list[DataFrame] = []
    while n := e.count():
        files = -(-n // ROWS_A_FILE)  # a graph that has become small is not kept in many small files
        salt = len(maps)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(salt)).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        one = both.groupBy("u").agg(F.min(rank("v")).alias("m")).select("u", F.least("m", rank("u")).alias("m"))
        one = materialise(one.coalesce(files), "steps")
        two = both.join(one.select(F.col("u").alias("v"), F.col("m").alias("far")), "v").groupBy("u").agg(F.min("far").alias("far"))
        move = materialise(one.join(two, "u").select("u", F.least("m", "far")["n"].alias("r")).coalesce(files), "moves")
        maps.append(move)
        left = e.join(move, "u").select(F.col("r").alias("a"), "v")
        left = left.join(move.withColumnRenamed("u", "v"), "v").select("a", F.col("r").alias("b")).where("a <> b")
        e = materialise(left.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct().coalesce(files), "edges")
    if not maps:
        return edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    root = maps[-1]
    for move in reversed(maps[:-1]):
        up = root.select(F.col("u").alias("r"), F.col("r").alias("top"))
        root = move.join(up, "r", "left").select("u", F.coalesce("top", "r").alias("r"))
    root = materialise(root, "roots")
    names = root.groupBy("r").agg(F.least(F.min("u"), F.col("r")).alias("component"))
    return root.join(names, "r").select(F.col("u").alias("node"), "component")
