"""Strongly connected components: one graph per task where graphs are small, rounds of joins where one is large."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import kinds
from ..plans.storage import configure, cut
from .traversal import function_scope

#: Edges up to which a graph is handled by one task.
SMALL_GRAPH = 2_000_000


def strong_components(nodes: Iterable[int], edges: Iterable[tuple[int, int]]) -> dict[int, int]:
    """node -> least node of its component: finishing order of one walk, then walks against the edges in reverse."""
    forward: dict[int, list[int]] = {n: [] for n in nodes}
    backward: dict[int, list[int]] = {n: [] for n in forward}
    for a, b in edges:
        if a in forward and b in forward:
            forward[a].append(b)
            backward[b].append(a)
    finished: list[int] = []
    seen: set[int] = set()
    for start in forward:
        if start in seen:
            continue
        seen.add(start)
        stack = [(start, iter(forward[start]))]
        while stack:
            node, rest = stack[-1]
            for other in rest:
                if other not in seen:
                    seen.add(other)
                    stack.append((other, iter(forward[other])))
                    break
            else:
                finished.append(node)
                stack.pop()
    of: dict[int, int] = {}
    for start in reversed(finished):
        if start in of:
            continue
        members, todo = [], [start]
        of[start] = start
        while todo:
            node = todo.pop()
            members.append(node)
            for other in backward[node]:
                if other not in of:
                    of[other] = start
                    todo.append(other)
        least = min(members)
        for node in members:
            of[node] = least
    return of


def _grouped(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    rows = nodes.select("graph_id", F.col("node_id").alias("a"), F.lit(None).cast("bigint").alias("b")).unionByName(edges.select("graph_id", F.col("source").alias("a"), F.col("target").alias("b")))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        alone = df["b"].isna()
        of = strong_components(df.loc[alone, "a"].tolist(), df.loc[~alone, ["a", "b"]].astype("int64").itertuples(index=False, name=None))
        return pd.DataFrame({"graph_id": df["graph_id"].iloc[0], "node_id": list(of), "root": list(of.values())})

    return rows.groupBy("graph_id").applyInPandas(run, "graph_id bigint, node_id bigint, root bigint")


def _by_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Colouring: the greatest id that reaches each node spreads forward; what its owner also reaches backward within
    its colour is a component. Nodes without edges in or out go first, as components of their own."""
    left = cut(nodes.select("graph_id", "node_id"))
    edges = cut(edges.filter("source <> target").select("graph_id", "source", "target").distinct())
    done: DataFrame | None = None
    key = ["graph_id", "node_id"]
    while not left.isEmpty():
        inner = edges.join(left.withColumnRenamed("node_id", "source"), ["graph_id", "source"], "left_semi").join(left.withColumnRenamed("node_id", "target"), ["graph_id", "target"], "left_semi")
        edges = cut(inner)
        out, into = edges.select("graph_id", F.col("source").alias("node_id")).distinct(), edges.select("graph_id", F.col("target").alias("node_id")).distinct()
        single = cut(left.join(out.join(into, key, "left_semi"), key, "left_anti").withColumn("root", F.col("node_id")))
        if not single.isEmpty():
            done = single if done is None else done.unionByName(single)
            left = cut(left.join(single, key, "left_anti"))
            continue
        colour = cut(left.withColumn("colour", F.col("node_id")))
        while True:
            spread = edges.join(colour.withColumnRenamed("node_id", "source"), ["graph_id", "source"]).groupBy("graph_id", F.col("target").alias("node_id")).agg(F.max("colour").alias("new"))
            after = cut(colour.join(spread, key, "left").withColumn("changed", F.col("new") > F.col("colour")).withColumn("colour", F.greatest("colour", "new")).drop("new"))
            if after.filter("changed").isEmpty():
                break
            colour = after.drop("changed")
        found = cut(colour.filter("colour = node_id").select("graph_id", "node_id", "colour"))
        new = found
        while not new.isEmpty():
            up = edges.join(new.withColumnRenamed("node_id", "target"), ["graph_id", "target"]).select("graph_id", F.col("source").alias("node_id"), "colour").distinct()
            new = cut(up.join(colour.select("graph_id", "node_id", "colour"), ["graph_id", "node_id", "colour"], "left_semi").join(found, key, "left_anti"))
            found = cut(found.unionByName(new))
        roots = found.groupBy("graph_id", "colour").agg(F.min("node_id").alias("root"))
        one = cut(found.join(roots, ["graph_id", "colour"]).select("graph_id", "node_id", "root"))
        done = one if done is None else done.unionByName(one)
        left = cut(left.join(one, key, "left_anti"))
    return done if done is not None else left.withColumn("root", F.col("node_id"))


def components(nodes: DataFrame, edges: DataFrame, small: int = SMALL_GRAPH) -> DataFrame:
    """graph_id, node_id, component_id (from 0, by least member), root, n_nodes, cyclic."""
    configure(nodes.sparkSession)
    nodes = nodes.select("graph_id", "node_id").distinct()
    edges = cut(edges.select("graph_id", "source", "target").distinct())
    sizes = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    large = cut(sizes.filter(F.col("n") > small).select("graph_id"))
    if large.isEmpty():
        of = _grouped(nodes, edges)
    else:
        of = _grouped(nodes.join(large, "graph_id", "left_anti"), edges.join(large, "graph_id", "left_anti")).unionByName(_by_rounds(nodes.join(large, "graph_id", "left_semi"), edges.join(large, "graph_id", "left_semi")))
    of = cut(of)
    loops = edges.filter("source = target").select("graph_id", F.col("source").alias("root"), F.lit(True).alias("loop"))
    rank = W.partitionBy("graph_id").orderBy("root")
    groups = of.groupBy("graph_id", "root").agg(F.count(F.lit(1)).alias("n_nodes")).withColumn("component_id", (F.row_number().over(rank) - 1).cast("bigint"))
    groups = groups.join(loops, ["graph_id", "root"], "left").withColumn("cyclic", (F.col("n_nodes") > 1) | F.coalesce("loop", F.lit(False)))
    return of.join(groups, ["graph_id", "root"]).select("graph_id", "node_id", "component_id", "root", "n_nodes", "cyclic")


def condensation(membership: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, source, target: distinct edges between different components."""
    a = membership.select("graph_id", F.col("node_id").alias("source"), F.col("component_id").alias("a"))
    b = membership.select("graph_id", F.col("node_id").alias("target"), F.col("component_id").alias("b"))
    joined = edges.select("graph_id", "source", "target").distinct().join(a, ["graph_id", "source"]).join(b, ["graph_id", "target"])
    return joined.filter("a <> b").select("graph_id", F.col("a").alias("source"), F.col("b").alias("target")).distinct()


def control_flow_components(nodes: DataFrame, edges: DataFrame, cfg: DataFrame, small: int = SMALL_GRAPH) -> DataFrame:
    """function_id, node_id, component_id, root, n_nodes, cyclic: of each function's control flow inside its own scope."""
    scope = cut(function_scope(nodes, edges))
    one, other = (scope.select("graph_id", "function_id", F.col("node_id").alias(end)) for end in ("source", "target"))
    own = cfg.select("graph_id", "source", "target").join(one, ["graph_id", "source"]).join(other, ["graph_id", "function_id", "target"])
    key = F.col("function_id").alias("graph_id")
    return components(scope.select(key, "node_id"), own.select(key, "source", "target"), small).withColumnRenamed("graph_id", "function_id")


def call_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, source, target: which function calls which, by call targets, call edges and control flow into calls."""
    scope = function_scope(nodes, edges).select("graph_id", "function_id", "node_id")
    calls = nodes.filter("call_target IS NOT NULL").select("graph_id", "node_id", F.col("call_target").alias("target"))
    flows = edges.filter(F.col("kind").isin(*kinds.CALL) | ((F.col("kind") == "ControlFlow") & (F.col("subkind") == "Call"))).select("graph_id", F.col("source").alias("node_id"), "target")
    functions = nodes.filter("tag = 'Function'").select("graph_id", F.col("node_id").alias("target"))
    both = calls.unionByName(flows).join(scope, ["graph_id", "node_id"]).join(functions, ["graph_id", "target"], "left_semi")
    return both.select("graph_id", F.col("function_id").alias("source"), "target").distinct()


def flags(membership: DataFrame) -> DataFrame:
    """graph_id, acyclic, self_cycles, larger_cycles: of each graph as a whole."""
    one = membership.filter("cyclic").select("graph_id", "component_id", "n_nodes").distinct()
    counts = one.groupBy("graph_id").agg(F.count_if(F.col("n_nodes") == 1).alias("self_cycles"), F.count_if(F.col("n_nodes") > 1).alias("larger_cycles"))
    return membership.select("graph_id").distinct().join(counts, "graph_id", "left").na.fill(0).select("graph_id", (F.col("self_cycles") + F.col("larger_cycles") == 0).alias("acyclic"), "self_cycles", "larger_cycles")
