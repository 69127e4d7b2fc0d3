"""Connected components by alternating large-star and small-star, on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, tune

MOST_ROUNDS = 100


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the least of its neighbours and itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node ties itself and its smaller neighbours to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    ties = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return ties.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (u, v), a root being the least node of its component.

    Loops and repeated edges do no harm; edges with a null end are left out; no edges give no rows. A round shuffles
    the edges, whose number never grows; rounds are logarithmic in a component's size.
    """
    spark = edges.sparkSession
    tune(spark)
    shared = Shared(spark, "components")
    now = shared.write(edges.select("u", "v").filter("u <> v").distinct(), "0")
    before = None
    for k in range(1, MOST_ROUNDS):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        now = shared.write(_small_star(_large_star(now)), str(k))
        shared.drop(str(k - 1))
    else:
        raise RuntimeError("the components have not settled")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
