"""Semi-naive loops: each round joins only the new rows, and lineage is cut after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import configure, cut

MOST_ROUNDS = 10_000


def closure(edges: DataFrame, most_depth: int | None = None) -> DataFrame:
    """(src, dst, depth) of all non-empty paths over `edges` (src, dst), at their least depth."""
    configure(edges.sparkSession)
    step = cut(edges.select("src", "dst").distinct())
    new = step.withColumn("depth", F.lit(1).cast("bigint"))
    known, depth = new, 1
    while most_depth is None or depth < most_depth:
        depth += 1
        found = new.select("src", F.col("dst").alias("mid")).join(step.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        new = cut(found.join(known, ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth).cast("bigint")))
        if new.isEmpty():
            break
        known = known.unionByName(new)
        if depth % 8 == 0:
            known = cut(known)
        if depth > MOST_ROUNDS:
            raise RuntimeError("no fixpoint")
    return known


def bfs(edges: DataFrame, seeds: DataFrame, most_depth: int | None = None) -> DataFrame:
    """(seed, node, depth): nodes reached from each seed (seed, node) over `edges` (src, dst), the seeds themselves at 0."""
    configure(edges.sparkSession)
    step = cut(edges.select("src", "dst").distinct())
    new = cut(seeds.select("seed", "node").distinct().withColumn("depth", F.lit(0).cast("bigint")))
    known, depth = new, 0
    while most_depth is None or depth < most_depth:
        depth += 1
        found = new.select("seed", F.col("node").alias("src")).join(step, "src").select("seed", F.col("dst").alias("node")).distinct()
        new = cut(found.join(known, ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth).cast("bigint")))
        if new.isEmpty():
            break
        known = known.unionByName(new)
        if depth % 8 == 0:
            known = cut(known)
        if depth > MOST_ROUNDS:
            raise RuntimeError("no fixpoint")
    return known


def tree_closure(parents: DataFrame) -> DataFrame:
    """(anc, desc, depth) of a forest given as (node, parent), by pointer doubling: rounds are logarithmic in depth.

    A chain ends at a parent that is no node, and at the first node that it meets again.
    """
    configure(parents.sparkSession)
    nodes = parents.select(F.col("node").alias("parent"))
    one = cut(parents.filter("parent is not null and parent <> node").join(nodes, "parent", "left_semi").select(F.col("parent").alias("anc"), F.col("node").alias("desc"), F.lit(1).cast("bigint").alias("depth")))
    known, reach = one, 1
    while True:
        upper = known.filter(F.col("depth") <= reach).select(F.col("anc").alias("top"), F.col("desc").alias("anc"), F.col("depth").alias("more"))
        edge = known.filter(F.col("depth") == reach)
        found = edge.join(upper, "anc").select(F.col("top").alias("anc"), "desc", (F.col("depth") + F.col("more")).alias("depth")).filter("anc <> desc")
        new = cut(found.groupBy("anc", "desc").agg(F.min("depth").alias("depth")).join(known, ["anc", "desc"], "left_anti"))
        if new.isEmpty():
            return known
        known, reach = cut(known.unionByName(new)), reach * 2
