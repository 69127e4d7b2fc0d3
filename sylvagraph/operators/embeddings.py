"""Message passing and vector functions, on double arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import cut


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: str) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: str, b: str) -> Column:
    """Euclidean distance."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x))


def cosine(a: str, b: str) -> Column:
    """0 for vectors of different length or without length; not clamped."""
    both = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (both > 0), dot(a, b) / both).otherwise(F.lit(0.0))


def mean_vector(df: DataFrame, keys: list[str], dim: int, vector: str = "vector") -> DataFrame:
    """keys, vector: the mean; partial sums per dimension stay columns, so it combines before the shuffle."""
    sums = df.groupBy(*keys).agg(*[F.sum(F.get(vector, F.lit(k))).alias(f"_{k}") for k in range(dim)], F.count(F.lit(1)).alias("_n"))
    return sums.select(*keys, F.array(*[F.col(f"_{k}") / F.col("_n") for k in range(dim)]).alias("vector"))


def message_pass(nodes: DataFrame, edges: DataFrame, rounds: int, dim: int) -> DataFrame:
    """graph_id, node_id, vector after `rounds` of averaging each node with its neighbours both ways, then ReLU."""
    both = edges.select("graph_id", F.col("source").alias("other"), F.col("target").alias("node_id")).unionByName(edges.select("graph_id", F.col("target").alias("other"), F.col("source").alias("node_id")))
    now = nodes.select("graph_id", "node_id", "vector")
    for _ in range(rounds):
        messages = both.join(now.withColumnRenamed("node_id", "other"), ["graph_id", "other"]).select("graph_id", "node_id", "vector").unionByName(now)
        mean = mean_vector(messages, ["graph_id", "node_id"], dim)
        now = cut(mean.withColumn("vector", F.transform("vector", lambda x: F.greatest(x, F.lit(0.0)))))
    return now


# The slot of each kind among the 16 of a node's type; 15 for all others.
TYPE_SLOTS = {
    "Root": 0, "Module": 1, "Class": 2, "Struct": 2, "Function": 3, "Variable": 4, "Field": 4, "If": 5, "While": 5, "For": 5, "Loop": 5, "Return": 6, "Break": 6, "Continue": 6,
    "Call": 7, "BinaryOp": 8, "UnaryOp": 8, "Assignment": 9, "Identifier": 10, "Literal": 11, "Block": 12, "Parameter": 13, "Try": 14, "Catch": 14, "Throw": 14,
}
N_SLOTS, DIM = 16, 128


def type_slot(tag: Column) -> Column:
    slot = F.lit(N_SLOTS - 1)
    for k in sorted(set(TYPE_SLOTS.values())):
        slot = F.when(tag.isin(*[t for t, s in TYPE_SLOTS.items() if s == k]), F.lit(k)).otherwise(slot)
    return slot


def initial(nodes: DataFrame, dim: int = DIM, seed: int = 0) -> DataFrame:
    """graph_id, node_id, slot, embedding: numbers in [-0.1, 0.1) that depend on node, place and seed alone, and 1 more at
    the slot of the node's type, if there is such a place.

    The lambda reads no column of its surroundings: where Spark compares plans it numbers lambda variables from 0 and takes
    a column of the same number, as the first ones of a session have, for one of them; joins over unions then fail."""
    node, slot = F.col("node_id").cast("bigint"), type_slot(F.col("tag"))
    first, step, far = node * 7919 + seed, node % 1009 * 31 + 104_729, F.lit(dim - 1).cast("bigint")
    mixed, places = F.sequence(first, first + step * far, step), F.sequence(-slot.cast("bigint"), far - slot, F.lit(1).cast("bigint"))
    vector = F.zip_with(mixed, places, lambda x, i: F.pmod(x, F.lit(65_537)) / 65_537 * 0.2 - 0.1 + F.when(i == 0, 1.0).otherwise(0.0))
    return nodes.select("graph_id", "node_id", slot.alias("slot"), vector.alias("embedding"))
