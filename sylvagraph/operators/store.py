"""Graph store: lookup, insertion, deduplication and referential checks on immutable tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE_KEY = ["graph_id", "source", "target", "kind", "subkind"]


def _same_edge(left: DataFrame, right: DataFrame):
    """Equality of edges but for id and label, nulls equal."""
    condition = F.lit(True)
    for c in EDGE_KEY:
        condition &= left[c].eqNullSafe(right[c])
    return condition


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both ends of which are nodes."""
    ids = nodes.select("graph_id", "node_id")
    source = ids.withColumnRenamed("node_id", "source")
    target = ids.withColumnRenamed("node_id", "target")
    return edges.join(source, ["graph_id", "source"], "left_semi").join(target, ["graph_id", "target"], "left_semi")


def connect(edges: DataFrame, new: DataFrame) -> DataFrame:
    return edges.unionByName(new, allowMissingColumns=True)


def new_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Of `new`, once each, the edges that `edges` lacks."""
    distinct = new.dropDuplicates(EDGE_KEY)
    return distinct.join(edges, _same_edge(distinct, edges), "left_anti")


def connect_unique(edges: DataFrame, new: DataFrame) -> DataFrame:
    return connect(edges, new_edges(edges, new))


def between(edges: DataFrame) -> DataFrame:
    """graph_id, source, target, n: parallel edges."""
    return edges.groupBy("graph_id", "source", "target").agg(F.count(F.lit(1)).alias("n"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, node_id, n_out, n_in."""
    out = edges.groupBy("graph_id", F.col("source").alias("node_id")).agg(F.count(F.lit(1)).alias("n_out"))
    into = edges.groupBy("graph_id", F.col("target").alias("node_id")).agg(F.count(F.lit(1)).alias("n_in"))
    keys = ["graph_id", "node_id"]
    return nodes.select(*keys).join(out, keys, "left").join(into, keys, "left").na.fill(0, ["n_out", "n_in"])


def root(nodes: DataFrame) -> DataFrame:
    """The first node of each graph."""
    return nodes.groupBy("graph_id").agg(F.min("node_id").alias("root"))


def subgraph(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes among `ids` (graph_id, node_id), and the edges between them."""
    wanted = ids.select("graph_id", "node_id").distinct()
    return nodes.join(wanted, ["graph_id", "node_id"], "left_semi"), valid_edges(edges, wanted)


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each graph: counts by kind and family, and cyclomatic complexity."""
    n = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("tag") == "Function").alias("n_functions"), F.count_if(F.col("tag") == "Class").alias("n_classes"))
    e = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_edges"), *[F.count_if(F.col("family") == f).alias(f"n_{f}") for f in ("ast", "cfg", "dfg", "call")])
    c = cyclomatic(edges.filter("family = 'cfg'"))
    counts = [c for c in e.columns if c != "graph_id"]
    return n.join(e, "graph_id", "left").join(c, "graph_id", "left").na.fill(0, counts).na.fill(1, ["cyclomatic"])


def cyclomatic(flow: DataFrame) -> DataFrame:
    """graph_id, cyclomatic: max(E - N, 0) + 2 over the control flow's edges and the nodes they touch."""
    ends = flow.select("graph_id", "source", "target")
    touched = ends.select("graph_id", F.explode(F.array("source", "target")).alias("n")).groupBy("graph_id").agg(F.count_distinct("n").alias("v"))
    return ends.groupBy("graph_id").agg(F.count(F.lit(1)).alias("e")).join(touched, "graph_id").select("graph_id", (F.greatest(F.col("e") - F.col("v"), F.lit(0)) + 2).alias("cyclomatic"))
