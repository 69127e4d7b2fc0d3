"""Similarity of graphs by histograms, features and neighbourhood labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import cut


def tag_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("graph_id", F.col("tag").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def _meets(hist: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with both counts of each label that both graphs have."""
    left = hist.select(F.col("graph_id").alias("a"), "label", F.col("n").alias("n_a"))
    right = hist.select(F.col("graph_id").alias("b"), "label", F.col("n").alias("n_b"))
    return pairs.join(left, "a").join(right, ["b", "label"])


def jaccard(hist: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, score: multiset Jaccard of label counts; two empty graphs score 1."""
    total = hist.groupBy("graph_id").agg(F.sum("n").alias("t"))
    common = _meets(hist, pairs).groupBy("a", "b").agg(F.sum(F.least("n_a", "n_b")).alias("c"))
    t_a, t_b = total.select(F.col("graph_id").alias("a"), F.col("t").alias("t_a")), total.select(F.col("graph_id").alias("b"), F.col("t").alias("t_b"))
    all_ = pairs.join(common, ["a", "b"], "left").join(t_a, "a", "left").join(t_b, "b", "left").na.fill(0)
    union = F.col("t_a") + F.col("t_b") - F.col("c")
    return all_.select("a", "b", F.when(union > 0, F.col("c") / union).otherwise(F.lit(1.0)).alias("score"))


def cosine(hist: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, score: cosine of label counts; 0 if either is empty."""
    norm = hist.groupBy("graph_id").agg(F.sqrt(F.sum((F.col("n") * F.col("n")).cast("double"))).alias("t"))
    dot = _meets(hist, pairs).groupBy("a", "b").agg(F.sum((F.col("n_a") * F.col("n_b")).cast("double")).alias("c"))
    t_a, t_b = norm.select(F.col("graph_id").alias("a"), F.col("t").alias("t_a")), norm.select(F.col("graph_id").alias("b"), F.col("t").alias("t_b"))
    all_ = pairs.join(dot, ["a", "b"], "left").join(t_a, "a", "left").join(t_b, "b", "left").na.fill(0.0)
    both = F.col("t_a") * F.col("t_b")
    return all_.select("a", "b", F.when(both > 0, F.col("c") / both).otherwise(F.lit(0.0)).alias("score"))


def wl_histogram(nodes: DataFrame, edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Neighbourhood labels after each round; the last round counts twice and the tags themselves don't count."""
    labels = nodes.select("graph_id", "node_id", F.col("tag").cast("string").alias("label"))
    around = edges.select("graph_id", F.col("source").alias("node_id"), F.col("target").alias("other")).unionByName(edges.select("graph_id", F.col("target").alias("node_id"), F.col("source").alias("other")))
    found = None
    for k in range(rounds):
        near = around.join(labels.select("graph_id", F.col("node_id").alias("other"), "label"), ["graph_id", "other"]).groupBy("graph_id", "node_id").agg(F.concat_ws(",", F.sort_array(F.collect_list("label"))).alias("near"))
        labels = cut(labels.join(near, ["graph_id", "node_id"], "left").select("graph_id", "node_id", F.md5(F.concat("label", F.lit("|"), F.coalesce("near", F.lit(""))).cast("binary")).alias("label")))
        for _ in range(2 if k == rounds - 1 else 1):
            found = labels if found is None else found.unionByName(labels)
    return found.groupBy("graph_id", "label").agg(F.count(F.lit(1)).alias("n"))


def feature_vectors(stats: DataFrame, depths: DataFrame | None = None) -> DataFrame:
    """graph_id, features: capped sizes, shares of edge families, capped counts, depth and complexity.

    stats: as operators.store.stats gives; depths: graph_id, depth, 1 where it is missing.
    """
    f = stats if depths is None else stats.join(depths, "graph_id", "left")
    depth = F.lit(1) if depths is None else F.coalesce("depth", F.lit(1))

    def capped(x, most: float):
        return F.least(x / most, F.lit(1.0))

    shares = [F.when(F.col("n_edges") > 0, F.col(f"n_{k}") / F.col("n_edges")).otherwise(F.lit(0.0)) for k in ("ast", "cfg", "dfg")]
    parts = [capped(F.col("n_nodes"), 1000.0), capped(F.col("n_edges"), 2000.0), *shares, capped(F.col("n_functions"), 100.0), capped(F.col("n_classes"), 50.0), capped(depth, 50.0), capped(F.col("cyclomatic"), 100.0)]
    return f.select("graph_id", F.array(*[p.cast("double") for p in parts]).alias("features"))


def feature_cosine(features: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, score in [0, 1]; 0 if either vector has no length."""
    a = features.select(F.col("graph_id").alias("a"), F.col("features").alias("x"))
    b = features.select(F.col("graph_id").alias("b"), F.col("features").alias("y"))

    def dot(p: str, q: str):
        return F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda acc, v: acc + v)

    size = F.sqrt(dot("x", "x")) * F.sqrt(dot("y", "y"))
    score = F.when(size > 0, F.least(F.greatest(dot("x", "y") / size, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    return pairs.join(a, "a").join(b, "b").select("a", "b", score.alias("score"))


def edit_similarity(hist: DataFrame, nodes: DataFrame, edges: DataFrame, pairs: DataFrame, structural: float = 0.7, label: float = 0.3) -> DataFrame:
    """a, b, score: an estimate of edit distance from the numbers of nodes and edges and the labels' Jaccard."""
    n = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    e = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("e"))
    size = n.join(e, "graph_id", "left").na.fill(0)
    x, y = (size.select(F.col("graph_id").alias(k), F.col("n").alias(f"n_{k}"), F.col("e").alias(f"e_{k}")) for k in ("a", "b"))
    all_ = jaccard(hist, pairs).join(x, "a", "left").join(y, "b", "left").na.fill(0)

    def like(c: str):
        return 1 - F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) / F.greatest(F.col(f"{c}_a"), F.col(f"{c}_b"), F.lit(1))

    return all_.select("a", "b", (structural * (0.6 * like("n") + 0.4 * like("e")) + label * F.col("score")).alias("score"))


def similarity(metric: str, nodes: DataFrame, edges: DataFrame, pairs: DataFrame, **weights: float) -> DataFrame:
    """a, b, score by the metric's name: jaccard, cosine or edit."""
    hist = tag_histogram(nodes)
    if metric == "edit":
        return edit_similarity(hist, nodes, edges, pairs, **weights)
    return {"jaccard": jaccard, "cosine": cosine}[metric](hist, pairs)
