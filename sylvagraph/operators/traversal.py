"""Traversal, positions and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import kinds
from ..functions.kinds import is_control_flow, is_expression
from ..plans.fixpoint import bfs, tree_closure


def children(edges: DataFrame) -> DataFrame:
    """graph_id, parent, child, ordinal (from 1), in order of edge ids."""
    order = W.partitionBy("graph_id", "source").orderBy("edge_id")
    return edges.filter("kind = 'AstChild'").select("graph_id", F.col("source").alias("parent"), F.col("target").alias("child"), F.row_number().over(order).cast("bigint").alias("ordinal"))


def ancestors(nodes: DataFrame) -> DataFrame:
    """anc, desc, depth over the parent pointers."""
    return tree_closure(nodes.select(F.col("node_id").alias("node"), "parent"))


def descendants(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed, node, depth: what each seed reaches over AstChild edges, itself left out."""
    step = edges.filter("kind = 'AstChild'").select(F.col("source").alias("src"), F.col("target").alias("dst"))
    return bfs(step, seeds.select(F.col("node_id").alias("seed"), F.col("node_id").alias("node"))).filter("depth > 0")


def depth(nodes: DataFrame) -> int:
    """Nodes on the longest path from the root; 0 for an empty graph."""
    if nodes.isEmpty():
        return 0
    return (ancestors(nodes).agg(F.max("depth")).first()[0] or 0) + 1


def neighbours(edges: DataFrame, family: str) -> DataFrame:
    """graph_id, node_id, successor, subkind in one family of edges; read the other way round for predecessors."""
    return edges.filter(F.col("family") == family).select("graph_id", F.col("source").alias("node_id"), F.col("target").alias("successor"), "subkind")


def incident(nodes: DataFrame, edges: DataFrame, family: str) -> DataFrame:
    """Nodes that an edge of the family touches."""
    ends = edges.filter(F.col("family") == family).select("graph_id", F.explode(F.array("source", "target")).alias("node_id")).distinct()
    return nodes.join(ends, ["graph_id", "node_id"], "left_semi")


def overlapping(nodes: DataFrame, ranges: DataFrame, width: int) -> DataFrame:
    """Nodes (graph_id, node_id, start, end) that overlap half-open ranges (graph_id, range_id, start, end).

    Both sides are dealt to cells of `width` that they touch and joined on them, so the range condition never meets all
    pairs; a pair is reported in the first cell that it shares.
    """

    def cells(df: DataFrame, start: str, end: str) -> DataFrame:
        return df.withColumn("cell", F.explode(F.sequence(F.expr(f"{start} div {width}"), F.expr(f"greatest({end} - 1, {start}) div {width}"))))

    left = cells(nodes.select("graph_id", "node_id", F.col("start").alias("n_start"), F.col("end").alias("n_end")), "n_start", "n_end")
    right = cells(ranges.select("graph_id", "range_id", F.col("start").alias("r_start"), F.col("end").alias("r_end")), "r_start", "r_end")
    both = left.join(right, ["graph_id", "cell"]).filter("n_start < r_end AND n_end > r_start")
    return both.filter(F.col("cell") == F.expr(f"greatest(n_start, r_start) div {width}"))


def at_offset(nodes: DataFrame, offsets: DataFrame, width: int, scopes_only: bool = False) -> DataFrame:
    """graph_id, offset, node_id of the smallest node (with a tag) that covers each offset; of equals the first one."""
    covering = nodes.filter(F.col("tag").isin(*kinds.SCOPES)) if scopes_only else nodes
    points = offsets.select("graph_id", F.col("offset").alias("range_id"), F.col("offset").alias("start"), (F.col("offset") + 1).alias("end"))
    found = overlapping(covering, points, width)
    best = found.groupBy("graph_id", F.col("range_id").alias("offset")).agg(F.min(F.struct((F.col("n_end") - F.col("n_start")).alias("size"), "node_id")).alias("best"))
    return best.select("graph_id", "offset", F.col("best.node_id").alias("node_id"))


def function_scope(nodes: DataFrame, edges: DataFrame, nested: bool = False) -> DataFrame:
    """graph_id, function_id, node_id: the nodes below each function, with itself; nested functions end the scope, unless
    they are wanted."""
    down = edges.filter("kind = 'AstChild'").select("graph_id", "source", "target")
    functions = nodes.filter("tag = 'Function'").select("graph_id", F.col("node_id"))
    if not nested:
        down = down.join(functions.withColumnRenamed("node_id", "target"), ["graph_id", "target"], "left_anti")
    step = down.select(F.struct("graph_id", F.col("source").alias("n")).alias("src"), F.struct("graph_id", F.col("target").alias("n")).alias("dst"))
    seeds = functions.select(F.struct("graph_id", F.col("node_id").alias("n")).alias("seed")).withColumn("node", F.col("seed"))
    return bfs(step, seeds).select("seed.graph_id", F.col("seed.n").alias("function_id"), F.col("node.n").alias("node_id"))


def _among(members: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges with both ends among a function's members, by function."""
    one, other = (members.select("graph_id", "function_id", F.col("node_id").alias(end)) for end in ("source", "target"))
    return edges.join(one, ["graph_id", "source"]).join(other, ["graph_id", "function_id", "target"])


def function_cfg(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(graph_id, function_id, node_id), edges by function: of each function itself and what controls flow or is an
    expression below it."""
    tags = nodes.select("graph_id", "node_id", "tag")
    scope = function_scope(nodes, edges, True).join(tags, ["graph_id", "node_id"])
    kept = scope.filter((F.col("node_id") == F.col("function_id")) | is_control_flow() | is_expression()).select("graph_id", "function_id", "node_id")
    return kept, _among(kept, edges)


def function_dfg(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of what lies below each function, itself left out, and has a data-flow edge."""
    flow = edges.filter("kind = 'DataFlow'")
    ends = flow.select("graph_id", F.col("source").alias("node_id")).unionByName(flow.select("graph_id", F.col("target").alias("node_id"))).distinct()
    kept = function_scope(nodes, edges, True).filter("node_id <> function_id").join(ends, ["graph_id", "node_id"], "left_semi").select("graph_id", "function_id", "node_id")
    return kept, _among(kept, edges)


def parents(nodes: DataFrame) -> DataFrame:
    """graph_id, node_id, parent, by the nodes' own pointers."""
    return nodes.filter("parent IS NOT NULL").select("graph_id", "node_id", "parent")
