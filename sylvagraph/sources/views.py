"""Graphs over the relational tables: (nodes, edges) pairs with the engine's columns.

A view is cheap and lazy; ids are made of keys, so nothing is sorted or numbered globally.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LEVEL = 1_000_000_000
EVENT_TAGS = {"view": "Block", "click": "Call", "purchase": "Assignment", "signup": "Variable", "error": "Throw"}


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tpch_ast(spark: SparkSession, sf_dir: str) -> Graph:
    """One tree: a root, regions as modules, nations as classes, customers as functions, orders as calls."""

    def level(name: str, key: str, at: int, tag: str, label: str, parent) -> DataFrame:
        t = table(spark, sf_dir, name)
        return t.select((F.col(key).cast("bigint") + at * LEVEL).alias("node_id"), F.lit(tag).alias("tag"), F.col(label).cast("string").alias("name"), parent.cast("bigint").alias("parent"))

    root = spark.range(1).select(F.lit(0).cast("bigint").alias("node_id"), F.lit("Root").alias("tag"), F.lit("root").alias("name"), F.lit(None).cast("bigint").alias("parent"))
    nodes = (
        root.unionByName(level("region", "r_regionkey", 1, "Module", "r_name", F.lit(0)))
        .unionByName(level("nation", "n_nationkey", 2, "Class", "n_name", F.col("n_regionkey") + LEVEL))
        .unionByName(level("customer", "c_custkey", 3, "Function", "c_name", F.col("c_nationkey").cast("bigint") + 2 * LEVEL))
        .unionByName(level("orders", "o_orderkey", 4, "Call", "o_orderstatus", F.col("o_custkey") + 3 * LEVEL))
    ).withColumn("graph_id", F.lit(1).cast("bigint"))
    edges = nodes.filter("parent is not null").select("graph_id", F.col("node_id").alias("edge_id"), F.col("parent").alias("source"), F.col("node_id").alias("target"), F.lit("ast").alias("family"), F.lit("AstChild").alias("kind"), F.lit(None).cast("string").alias("subkind"))
    return Graph(nodes, edges)


def events_cfg(spark: SparkSession, sf_dir: str) -> Graph:
    """A graph for each user: events as nodes, each followed by the user's next one."""
    events = table(spark, sf_dir, "events")
    tag = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in EVENT_TAGS.items()], F.lit("Unknown"))
    following = W.partitionBy("user_id").orderBy("ts", "event_id")
    nodes = events.select(F.col("user_id").alias("graph_id"), F.col("event_id").alias("node_id"), tag.alias("tag"), F.col("event_type").alias("name"), "ts", "value")
    edges = events.select(F.col("user_id").alias("graph_id"), F.col("event_id").alias("edge_id"), F.col("event_id").alias("source"), F.lead("event_id").over(following).alias("target"), F.lit("cfg").alias("family"), F.lit("ControlFlow").alias("kind"), F.lit("Sequential").alias("subkind")).filter("target is not null")
    return Graph(nodes, edges)


def event_types_cfg(spark: SparkSession, sf_dir: str) -> Graph:
    """A graph for each user: event types as nodes, distinct transitions as edges."""
    following = W.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events").select("user_id", "event_type", F.lead("event_type").over(following).alias("next_type"))
    nodes = events.select(F.col("user_id").alias("graph_id"), F.col("event_type").alias("name")).distinct()
    edges = events.filter("next_type is not null").select(F.col("user_id").alias("graph_id"), F.col("event_type").alias("source"), F.col("next_type").alias("target")).distinct()
    return Graph(nodes, edges)


def nation_calls(spark: SparkSession, sf_dir: str, quantity: int = 45) -> Graph:
    """Nations as functions; a call from a customer's nation to that of a supplier of the customer's selected items."""
    items = table(spark, sf_dir, "lineitem").filter((F.col("l_quantity") >= quantity) & (F.col("l_discount") < 0.005) & (F.col("l_tax") < 0.005)).select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("source"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("bigint").alias("target"))
    pairs = items.join(orders, items.l_orderkey == orders.o_orderkey).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    nodes = table(spark, sf_dir, "nation").select(F.lit(1).cast("bigint").alias("graph_id"), F.col("n_nationkey").cast("bigint").alias("node_id"), F.lit("Function").alias("tag"), F.col("n_name").alias("name"))
    edges = pairs.select(F.lit(1).cast("bigint").alias("graph_id"), "source", "target", F.lit("call").alias("family"), F.lit("StaticCall").alias("kind"), F.lit(None).cast("string").alias("subkind"))
    return Graph(nodes, edges)


def class_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions as traits, nations as classes that implement them; market segments as functions of both; a field of the
    region's type in each nation with suppliers, read by the functions of segments with indebted customers."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("n"), F.col("n_regionkey").cast("bigint").alias("r"), "n_name")
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("r"), "r_name")
    served = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("bigint").alias("n"), F.col("c_mktsegment").alias("s")).agg(F.min("c_acctbal").alias("low")).join(nations, "n")
    fields = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("bigint").alias("n")).distinct().join(nations, "n").join(regions, "r")
    letter = F.ascii("s").cast("bigint")
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, i, tag: str, name, type_name=none) -> DataFrame:
        return df.select(F.lit(1).cast("bigint").alias("graph_id"), i.alias("node_id"), F.lit(tag).alias("tag"), name.alias("name"), type_name.alias("type_name"))

    def links(df: DataFrame, a, b, kind: str) -> DataFrame:
        return df.select(F.lit(1).cast("bigint").alias("graph_id"), b.alias("edge_id"), a.alias("source"), b.alias("target"), F.lit(kind).alias("kind"), none.alias("subkind"))

    r, n = F.col("r") + 1, F.col("n") + 100
    of_class, of_trait, field, use = 100_000 + F.col("n") * 1000 + letter, 200_000 + F.col("r") * 1000 + letter, F.col("n") + 300_000, 400_000 + F.col("n") * 1000 + letter
    by_region = served.select("r", "s").distinct()
    reading = served.filter("low < 0").join(fields.select("n"), "n", "left_semi")
    nodes = rows(regions, r, "Trait", F.col("r_name")).unionByName(rows(nations, n, "Class", F.col("n_name"))).unionByName(rows(served, of_class, "Function", F.col("s"))).unionByName(rows(by_region, of_trait, "Function", F.col("s")))
    nodes = nodes.unionByName(rows(fields, field, "Field", F.lit("supply"), F.col("r_name"))).unionByName(rows(reading, use, "Identifier", F.lit("supply")))
    edges = links(nations, n, r, "Implements").unionByName(links(served, n, of_class, "AstChild")).unionByName(links(by_region, r, of_trait, "AstChild"))
    edges = edges.unionByName(links(fields, n, field, "AstChild")).unionByName(links(fields, field, r, "TypeOf")).unionByName(links(reading, of_class, use, "AstChild"))
    return Graph(nodes, edges)
