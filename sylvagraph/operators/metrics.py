"""Object-oriented metrics of a graph: sizes, inheritance, composition, cohesion, coupling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import bfs
from ..plans.storage import cut

CLASSES = ("Class", "Struct")
TYPED = ("Field", "Variable", "Parameter", "TypeAnnotation")


def _tagged(nodes: DataFrame, tags: tuple[str, ...], name: str) -> DataFrame:
    return nodes.filter(F.col("tag").isin(*tags)).select("graph_id", F.col("node_id").alias(name))


def members(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, class_id, node_id, tag: functions and fields of each class, also those inside its impls and blocks."""
    down = edges.filter("kind = 'AstChild'").select("graph_id", F.col("source").alias("src"), F.col("target").alias("dst"))
    first = down.join(_tagged(nodes, CLASSES, "src"), ["graph_id", "src"], "left_semi").select(F.struct("graph_id", "src").alias("seed"), F.struct("graph_id", "dst").alias("node"))
    wrapped = down.join(_tagged(nodes, ("Impl", "Block"), "src"), ["graph_id", "src"], "left_semi").select(F.struct("graph_id", F.col("src").alias("dst")).alias("src"), F.struct("graph_id", "dst").alias("dst"))
    reached = bfs(wrapped, first).select("seed.graph_id", F.col("seed.src").alias("class_id"), F.col("node.dst").alias("node_id"))
    kinds = nodes.filter(F.col("tag").isin("Function", "Field")).select("graph_id", "node_id", "tag", "name")
    return reached.distinct().join(kinds, ["graph_id", "node_id"])


def cohesion(nodes: DataFrame, edges: DataFrame, own: DataFrame) -> DataFrame:
    """graph_id, class_id, lcom of classes with two methods or more and a field.

    Pairs of methods that share a field are found by joining on fields; the rest is counted, not listed.
    """
    methods = own.filter("tag = 'Function'").select("graph_id", "class_id", F.col("node_id").alias("method"))
    fields = own.filter("tag = 'Field'").select("graph_id", "class_id", F.col("node_id").alias("field"), "name")
    down = edges.filter("kind = 'AstChild'").select(F.struct("graph_id", F.col("source").alias("n")).alias("src"), F.struct("graph_id", F.col("target").alias("n")).alias("dst"))
    seeds = methods.select(F.struct("graph_id", F.col("method").alias("n")).alias("seed")).distinct().withColumn("node", F.col("seed"))
    below = bfs(down, seeds).filter("depth > 0").select("seed.graph_id", F.col("seed.n").alias("method"), F.col("node.n").alias("node_id"))
    reads = below.join(nodes.filter(F.col("tag").isin("MemberAccess", "Identifier")).select("graph_id", "node_id", "name"), ["graph_id", "node_id"]).select("graph_id", "method", "name").distinct()
    touched = methods.join(reads, ["graph_id", "method"]).join(fields, ["graph_id", "class_id", "name"]).select("graph_id", "class_id", "method", "field").distinct()
    other = touched.select("graph_id", "class_id", "field", F.col("method").alias("second"))
    shared = touched.join(other, ["graph_id", "class_id", "field"]).filter("method < second").select("graph_id", "class_id", "method", "second").distinct().groupBy("graph_id", "class_id").agg(F.count(F.lit(1)).alias("shared"))
    sizes = own.groupBy("graph_id", "class_id").agg(F.count_if(F.col("tag") == "Function").alias("m"), F.count_if(F.col("tag") == "Field").alias("f")).filter("m >= 2 AND f >= 1")
    pairs = F.col("m") * (F.col("m") - 1) / 2
    return sizes.join(shared, ["graph_id", "class_id"], "left").na.fill(0, ["shared"]).select("graph_id", "class_id", (F.greatest(pairs - 2 * F.col("shared"), F.lit(0.0)) / pairs).alias("lcom"))


def coupling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, class_id, name of every foreign type that a class names or derives from."""
    classes = nodes.filter(F.col("tag").isin(*CLASSES)).select("graph_id", F.col("node_id").alias("class_id"), F.col("name").alias("class_name"))
    down = edges.filter("kind = 'AstChild'").select(F.struct("graph_id", F.col("source").alias("n")).alias("src"), F.struct("graph_id", F.col("target").alias("n")).alias("dst"))
    seeds = classes.select(F.struct("graph_id", F.col("class_id").alias("n")).alias("seed")).withColumn("node", F.col("seed"))
    below = bfs(down, seeds).filter("depth > 0").select("seed.graph_id", F.col("seed.n").alias("class_id"), F.col("node.n").alias("node_id"))
    typed = nodes.filter(F.col("tag").isin(*TYPED) & F.col("type_name").isNotNull()).select("graph_id", "node_id", F.col("type_name").alias("name"))
    derived = edges.filter(F.col("kind").isin("Inherits", "Implements")).select("graph_id", F.col("source").alias("class_id"), F.col("target").alias("node_id"))
    bases = nodes.filter(F.col("tag").isin(*CLASSES, "Trait")).select("graph_id", "node_id", "name")
    named = below.join(typed, ["graph_id", "node_id"]).unionByName(derived.join(bases, ["graph_id", "node_id"])).select("graph_id", "class_id", "name")
    return named.join(classes, ["graph_id", "class_id"]).filter(~F.col("name").eqNullSafe(F.col("class_name"))).select("graph_id", "class_id", "name").distinct()


def pattern_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A row for each graph: class_count, interface_count, inheritance_count, composition_count,
    avg_methods_per_class, cohesion, coupling. nodes need type_name."""
    own = cut(members(nodes, edges))
    counts = nodes.groupBy("graph_id").agg(F.count_if(F.col("tag").isin(*CLASSES)).alias("class_count"), F.count_if(F.col("tag") == "Trait").alias("interface_count"))
    derived = edges.filter(F.col("kind").isin("Inherits", "Implements")).groupBy("graph_id").agg(F.count(F.lit(1)).alias("inheritance_count"))
    names = nodes.filter(F.col("tag").isin(*CLASSES)).select("graph_id", F.col("name").alias("type_name")).distinct()
    composed = nodes.filter("tag = 'Field'").join(names, ["graph_id", "type_name"], "left_semi").groupBy("graph_id").agg(F.count(F.lit(1)).alias("composition_count"))
    methods = own.filter("tag = 'Function'").groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_methods"))
    lcom = cohesion(nodes, edges, own).groupBy("graph_id").agg(F.avg("lcom").alias("cohesion"))
    cbo = coupling(nodes, edges).groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_coupled"))
    all_ = counts
    for part in (derived, composed, methods, lcom, cbo):
        all_ = all_.join(part, "graph_id", "left")
    all_ = all_.na.fill(0)

    def per_class(column: str):
        return F.when(F.col("class_count") > 0, F.col(column) / F.col("class_count")).otherwise(F.lit(0.0))

    return all_.select("graph_id", "class_count", "interface_count", "inheritance_count", "composition_count", per_class("n_methods").alias("avg_methods_per_class"), "cohesion", per_class("n_coupled").alias("coupling"))
