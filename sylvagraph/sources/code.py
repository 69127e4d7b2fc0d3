"""A synthetic program over the customers: ten functions to a file, each with up to six statements of eight shapes.

It holds every construct that flow extraction knows, and its ids are made of keys, so SQL can state what must come out.
A file is a graph; customer c is the function c * 1000 of file c div 10, with a parameter and a block below it; its
statement j (from 1 to 1 + c mod 6) has the shape (c + 3 j) mod 8 and nodes from c * 1000 + 10 j on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import Graph, table

#: Nodes of each shape: offset, parent's offset (-1: the block), tag, name, operator, literal kind, integer.
SHAPES: tuple[tuple[tuple, ...], ...] = (
    ((0, -1, "Assignment", None, "=", None, None), (1, 0, "Identifier", "a", None, None, None), (2, 0, "MemberAccess", "size", None, None, None), (3, 2, "Identifier", "p", None, None, None)),
    ((0, -1, "If", None, None, None, None), (1, 0, "Identifier", "a", None, None, None), (2, 0, "Assignment", None, "=", None, None), (3, 2, "Identifier", "b", None, None, None), (4, 2, "Identifier", "a", None, None, None), (5, 0, "Else", None, None, None, None), (6, 5, "Call", None, None, None, None)),
    ((0, -1, "While", None, None, None, None), (1, 0, "BinaryOp", None, "<", None, None), (2, 0, "Block", None, None, None, None), (3, 2, "Assignment", None, "+=", None, None), (4, 3, "Identifier", "b", None, None, None), (5, 3, "Identifier", "p", None, None, None), (6, 1, "Identifier", "b", None, None, None), (7, 1, "Literal", None, None, "Integer", 10)),
    ((0, -1, "For", None, None, None, None), (1, 0, "Variable", "i", None, None, None), (2, 0, "Block", None, None, None, None), (3, 2, "If", None, None, None, None), (4, 3, "Identifier", "i", None, None, None), (5, 3, "Break", None, None, None, None)),
    ((0, -1, "Loop", None, None, None, None), (1, 0, "Block", None, None, None, None), (2, 1, "For", None, None, None, None), (3, 1, "Continue", None, None, None, None), (4, 2, "Variable", "i", None, None, None), (5, 2, "Block", None, None, None, None)),
    ((0, -1, "Match", None, None, None, None), (1, 0, "Identifier", "a", None, None, None), (2, 0, "MatchArm", None, None, None, None), (3, 2, "Literal", None, None, "Integer", 1), (4, 2, "Identifier", "a", None, None, None), (5, 0, "MatchArm", None, None, None, None), (6, 5, "IndexAccess", None, None, None, None), (7, 6, "Identifier", "a", None, None, None), (8, 6, "Literal", None, None, "Integer", 0)),
    ((0, -1, "Try", None, None, None, None), (1, 0, "Block", None, None, None, None), (2, 1, "Throw", None, None, None, None), (3, 2, "Identifier", "b", None, None, None), (4, 0, "Catch", None, None, None, None), (5, 4, "Block", None, None, None, None), (6, 5, "Call", None, None, None, None), (7, 0, "Finally", None, None, None, None), (8, 7, "Identifier", "a", None, None, None)),
    ((0, -1, "Return", None, None, None, None), (1, 0, "Call", None, None, None, None), (2, 1, "Identifier", "callee", None, None, None), (3, 1, "Identifier", "p", None, None, None)),
)
_SHAPE = "shape int, at int, up int, tag string, name string, operator string, literal_kind string, lit_int bigint"


def customer_code(spark: SparkSession, sf_dir: str) -> Graph:
    """Nodes with tag, name, operator, parent, call_target, literal_kind, lit_int, unknown_kind; AST and call edges.

    A returned call calls the function of the file's customer with the next lower even number, which may be itself."""
    shapes = spark.createDataFrame([(k, *n) for k, shape in enumerate(SHAPES) for n in shape], _SHAPE)  # a few dozen rows
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("c"))
    c = c.select("c", F.expr("c div 10").alias("graph_id"), (F.col("c") * 1000).alias("f"), (F.col("c") - F.col("c") % 2).alias("callee"))
    none = F.lit(None)

    def one(at: int, tag: str, name, parent) -> DataFrame:
        return c.select("graph_id", (F.col("f") + at).alias("node_id"), F.lit(tag).alias("tag"), name.cast("string").alias("name"), none.cast("string").alias("operator"), parent.cast("bigint").alias("parent"), none.cast("bigint").alias("call_target"), none.cast("string").alias("literal_kind"), none.cast("bigint").alias("lit_int"))

    j = F.explode(F.sequence(F.lit(1).cast("bigint"), 1 + F.col("c") % 6))
    lines = c.withColumn("j", j).withColumn("shape", ((F.col("c") + 3 * F.col("j")) % 8).cast("int")).join(F.broadcast(shapes), "shape")
    base = F.col("f") + 10 * F.col("j")
    callee = F.concat(F.lit("f"), F.col("callee").cast("string"))
    calls = (F.col("shape") == 7) & (F.col("tag") == "Call")
    inner = lines.select(
        "graph_id", (base + F.col("at")).alias("node_id"), "tag", F.when(F.col("name") == "callee", callee).otherwise(F.col("name")).alias("name"), "operator",
        F.when(F.col("up") < 0, F.col("f") + 2).otherwise(base + F.col("up")).alias("parent"), F.when(calls, F.col("callee") * 1000).alias("call_target"), "literal_kind", "lit_int",
    )
    nodes = one(0, "Function", F.concat(F.lit("f"), F.col("c").cast("string")), none).unionByName(one(1, "Parameter", F.lit("p"), F.col("f"))).unionByName(one(2, "Block", none, F.col("f"))).unionByName(inner)
    nodes = nodes.withColumn("unknown_kind", none.cast("string"))
    edges = nodes.filter("parent IS NOT NULL").select("graph_id", (F.col("node_id") * 2).alias("edge_id"), F.col("parent").alias("source"), F.col("node_id").alias("target"), F.lit("AstChild").alias("kind"), none.cast("string").alias("subkind"))
    called = nodes.filter("call_target IS NOT NULL").select("graph_id", (F.col("node_id") * 2 + 1).alias("edge_id"), F.col("node_id").alias("source"), F.col("call_target").alias("target"), F.lit("StaticCall").alias("kind"), none.cast("string").alias("subkind"))
    return Graph(nodes, edges.unionByName(called))


METHOD_NAMES = ("create_one", "get_instance", "notify_all", "update", "new", "run")


def customer_classes(spark: SparkSession, sf_dir: str) -> Graph:
    """Each customer c as a class of file c div 10, with 1 + c mod 4 methods, c mod 3 fields and, if c is even, the
    interface T<c mod 5> of its file, whose type its second field has."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("c")).withColumn("graph_id", F.expr("c div 10"))
    none, text = F.lit(None), lambda x: x.cast("string")

    def rows(df: DataFrame, i, tag: str, name, type_name=none, static=F.lit(False), visibility=F.lit("Public")) -> DataFrame:
        return df.select("graph_id", i.cast("bigint").alias("node_id"), F.lit(tag).alias("tag"), text(name).alias("name"), text(type_name).alias("type_name"), static.alias("is_static"), visibility.alias("visibility"))

    trait = 10_000_000_000 + F.col("graph_id") * 10 + F.col("c") % 5
    methods = c.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("c") % 4)))
    names = F.element_at(F.array(*[F.lit(x) for x in METHOD_NAMES]), ((F.col("c") + F.col("k")) % 6 + 1).cast("int"))
    fields = c.withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("c") % 3))).filter("k <= c % 3 AND k >= 1 AND c % 3 > 0")
    of_trait, class_name = F.concat(F.lit("T"), text(F.col("c") % 5)), F.concat(F.lit("C"), text(F.col("c")))
    own, base = F.col("c") * 100, F.col("c") * 100 + F.col("k")
    nodes = rows(c, own, "Class", class_name).unionByName(rows(c.withColumn("t", trait).dropDuplicates(["t"]), F.col("t"), "Trait", of_trait))
    nodes = nodes.unionByName(rows(methods, base + 10, "Function", names, static=F.col("k") % 2 == 0, visibility=F.when(F.col("c") % 3 == 0, "Private").otherwise("Public")))
    nodes = nodes.unionByName(rows(fields, base + 20, "Field", F.when(F.col("k") == 1, "instance").otherwise("handler"), F.when(F.col("k") == 1, class_name).otherwise(of_trait)))

    def links(df: DataFrame, a, b, kind: str) -> DataFrame:
        return df.select("graph_id", b.alias("edge_id"), a.alias("source"), b.alias("target"), F.lit(kind).alias("kind"), text(none).alias("subkind"))

    return Graph(nodes, links(methods, own, base + 10, "AstChild").unionByName(links(fields, own, base + 20, "AstChild")).unionByName(links(c.filter("c % 2 = 0"), own, trait, "Implements")))
