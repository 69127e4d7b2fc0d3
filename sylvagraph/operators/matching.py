"""Subgraph matching: a pattern is compiled to a chain of joins, one for each pattern node.

A match is injective, agrees in kinds, and has every edge of the pattern; the target may have more. Node order follows
the pattern's edges, so that each join but the first of a connected part is an equi-join; parts that hang together by
nothing are joined at last, by graph.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kinds


@dataclass(frozen=True)
class Pattern:
    """nodes: tag of each pattern node by number; edges: (source, target, kind)."""

    name: str
    nodes: tuple[str, ...]
    edges: tuple[tuple[int, int, str], ...] = field(default=())


def _edge_like(kind: str, relaxed: bool) -> Column:
    """kind is an edge kind, with `ControlFlow:Sub` or `DataFlow:Sub` for one sub-kind."""
    kind, _, sub = kind.partition(":")
    exact = F.col("kind") == kind
    if relaxed:
        for group in (kinds.AST, ("ControlFlow",), ("DataFlow",), kinds.CALL):
            if kind in group:
                return F.col("kind").isin(*group)
        return exact
    return exact & (F.col("subkind") == sub) if sub else exact


def _node_like(tag: str, relaxed: bool) -> Column:
    if relaxed:
        for name, group in (("decl", kinds.MATCH_DECLARATIONS), ("expr", kinds.MATCH_EXPRESSIONS), ("stmt", kinds.MATCH_STATEMENTS)):
            if tag in group:
                return kinds.match_class() == name
    return F.col("tag") == tag


def match(pattern: Pattern, nodes: DataFrame, edges: DataFrame, relaxed: bool = False, most: int = 0) -> DataFrame:
    """graph_id, p0, p1, ...: all embeddings, each as one row; `most` > 0 keeps so many in each graph."""
    own = {k: nodes.filter(_node_like(tag, relaxed)).select("graph_id", F.col("node_id").alias(f"p{k}")) for k, tag in enumerate(pattern.nodes)}
    links = [(a, b, edges.filter(_edge_like(kind, relaxed)).select("graph_id", F.col("source").alias(f"p{a}"), F.col("target").alias(f"p{b}")).distinct()) for a, b, kind in pattern.edges]
    found: DataFrame | None = None
    placed: list[int] = []
    rest = list(links)

    def different(df: DataFrame, k: int) -> DataFrame:
        for j in placed:
            df = df.filter(F.col(f"p{k}") != F.col(f"p{j}"))
        return df

    def settle(df: DataFrame) -> DataFrame:
        """Edges of which both ends are placed only filter."""
        for link in [x for x in rest if x[0] in placed and x[1] in placed]:
            rest.remove(link)
            a, b, rows = link
            if a == b:
                rows = edges_loops(rows, a)
            df = df.join(rows, list(dict.fromkeys(["graph_id", f"p{a}", f"p{b}"])), "left_semi")
        return df

    def edges_loops(rows: DataFrame, k: int) -> DataFrame:
        return rows.select("graph_id", f"p{k}")

    loops = {a: edges.filter(_edge_like(kind, relaxed)).filter("source = target").select("graph_id", F.col("source").alias(f"p{a}")).distinct() for a, b, kind in pattern.edges if a == b}
    rest = [x for x in rest if x[0] != x[1]]
    for k, rows in loops.items():
        own[k] = own[k].join(rows, ["graph_id", f"p{k}"], "left_semi")
    while len(placed) < len(pattern.nodes):
        link = next((x for x in rest if (x[0] in placed) != (x[1] in placed)), None)
        if link is not None and found is not None:
            rest.remove(link)
            a, b, rows = link
            old, k = (a, b) if a in placed else (b, a)
            found = different(found.join(rows, ["graph_id", f"p{old}"]).join(own[k], ["graph_id", f"p{k}"], "left_semi"), k)
        else:
            # the next part starts at a node with the most edges
            k = max((k for k in range(len(pattern.nodes)) if k not in placed), key=lambda k: sum(k in x[:2] for x in rest))
            found = own[k] if found is None else different(found.join(own[k], "graph_id"), k)
        placed.append(k)
        found = settle(found)
    columns = [f"p{k}" for k in range(len(pattern.nodes))]
    found = found.select("graph_id", *columns)
    if most:
        from pyspark.sql import Window as W

        found = found.withColumn("_n", F.row_number().over(W.partitionBy("graph_id").orderBy(*columns))).filter(F.col("_n") <= most).drop("_n")
    return found
