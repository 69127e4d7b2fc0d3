"""Rule-based classification of classes by features of everything below them.

All classes are measured in one aggregation; rules are Column expressions over that row, so scoring needs no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import bfs
from .metrics import CLASSES

REPORTED = 0.7
# Words that mark methods and fields.
FACTORY_STARTS = ("create", "make", "build", "new_")
FACTORY_NAMES = ("new",)
OBSERVER_STARTS = ("register", "subscribe", "notify", "update", "add_observer", "remove_observer")
INSTANCE_PARTS = ("instance", "singleton")
FEATURES = ("method_count", "field_count", "method_field_ratio", "inheritance_depth", "interface_count", "static_method_count", "has_private_constructor", "factory_method_count", "observer_method_count", "interface_field_count", "is_decorator_candidate", "static_share")


def _one_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, class_id, class_name, FEATURES, and has_get_instance, has_instance_field for each class.

    nodes need type_name, is_static, visibility. Flags are counted as 0 or 1, so that FEATURES is the feature vector.
    """
    classes = nodes.filter(F.col("tag").isin(*CLASSES)).select("graph_id", F.col("node_id").alias("class_id"), F.col("name").alias("class_name"))
    down = edges.filter("kind = 'AstChild'").select(F.struct("graph_id", F.col("source").alias("n")).alias("src"), F.struct("graph_id", F.col("target").alias("n")).alias("dst"))
    seeds = classes.select(F.struct("graph_id", F.col("class_id").alias("n")).alias("seed")).withColumn("node", F.col("seed"))
    below = bfs(down, seeds).filter("depth > 0").select("seed.graph_id", F.col("seed.n").alias("class_id"), F.col("node.n").alias("node_id"))
    traits = nodes.filter("tag = 'Trait'").select("graph_id", F.col("node_id").alias("target"), F.col("name").alias("type_name"))
    derived = edges.filter(F.col("kind").isin("Implements", "Inherits")).select("graph_id", F.col("source").alias("class_id"), "target", "kind")
    implemented = derived.filter("kind = 'Implements'").join(traits, ["graph_id", "target"]).select("graph_id", "class_id", "type_name", F.lit(True).alias("implemented")).distinct()
    wanted = nodes.filter(F.col("tag").isin("Function", "Field")).select("graph_id", "node_id", "tag", "name", "type_name", "is_static", "visibility")
    rows = below.join(wanted, ["graph_id", "node_id"]).join(classes, ["graph_id", "class_id"]).join(implemented, ["graph_id", "class_id", "type_name"], "left")
    low = F.lower(F.coalesce("name", F.lit("")))
    method, field, static = F.col("tag") == "Function", F.col("tag") == "Field", F.coalesce("is_static", F.lit(False))
    instance = _one_of([low.contains(w) for w in INSTANCE_PARTS])
    counted = rows.groupBy("graph_id", "class_id").agg(
        F.count_if(method).alias("method_count"),
        F.count_if(field).alias("field_count"),
        F.count_if(method & static).alias("static_method_count"),
        F.max((method & ((low == "new") | low.contains("init")) & (F.col("visibility") == "Private")).cast("int")).alias("has_private_constructor"),
        F.count_if(method & _one_of([low.startswith(w) for w in FACTORY_STARTS] + [low == w for w in FACTORY_NAMES])).alias("factory_method_count"),
        F.count_if(method & _one_of([low.startswith(w) for w in OBSERVER_STARTS])).alias("observer_method_count"),
        F.count_if(field & F.coalesce("implemented", F.lit(False))).alias("interface_field_count"),
        F.max((method & static & (instance | (low == "get"))).cast("int")).alias("has_get_instance"),
        F.max((field & (instance | (low == "self")) & (F.col("type_name") == F.col("class_name"))).cast("int")).alias("has_instance_field"),
    )
    bases = derived.groupBy("graph_id", "class_id").agg(F.count_if(F.col("kind") == "Implements").alias("interface_count"), F.count_if(F.col("kind") == "Inherits").alias("inheritance_depth"))
    all_ = classes.join(counted, ["graph_id", "class_id"], "left").join(bases, ["graph_id", "class_id"], "left").na.fill(0)
    return all_.withColumns({
        "method_field_ratio": F.col("method_count") / F.greatest(F.col("field_count"), F.lit(1)),
        "is_decorator_candidate": (F.col("interface_field_count") > 0).cast("int"),
        "static_share": F.col("static_method_count") / F.greatest(F.col("method_count"), F.lit(1)),
    })


def vector(f: DataFrame) -> DataFrame:
    return f.select("graph_id", "class_id", F.array(*[F.col(c).cast("double") for c in FEATURES]).alias("vector"))


def _if(test: Column, score) -> Column:
    return F.when(test, score).otherwise(F.lit(0.0))


def scores(f: DataFrame, hybrid: bool = False, least: float = REPORTED) -> DataFrame:
    """graph_id, class_id, pattern, score of every rule that fires with enough confidence.

    hybrid: a second opinion that agrees raises a score by a tenth, to 1 at most; the second opinion is the rules' own.
    """
    c = F.col
    single = _if(c("has_get_instance") > 0, 0.4) + _if(c("has_instance_field") > 0, 0.3) + _if(c("has_private_constructor") > 0, 0.2) + _if((c("static_method_count") > 0) & (c("method_count") <= 5), 0.1)
    fired = {
        "Singleton": F.when(single >= 0.5, single),
        "Factory": F.when(c("factory_method_count") >= 2, 0.5 + F.least(c("factory_method_count") * 0.1, F.lit(0.4))).when((c("factory_method_count") == 1) & (c("method_count") <= 3), F.lit(0.6)),
        "Observer": F.when(c("observer_method_count") >= 2, 0.5 + F.least(c("observer_method_count") * 0.15, F.lit(0.4))),
        "Strategy": F.when((c("interface_field_count") >= 1) & (c("interface_count") == 0), 0.6 + F.least(c("interface_field_count") * 0.1, F.lit(0.3))),
        "Decorator": F.when(c("is_decorator_candidate") > 0, F.lit(0.75)),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("pattern"), v.cast("double").alias("score")) for k, v in fired.items()]))
    found = f.select("graph_id", "class_id", rows.alias("r")).select("graph_id", "class_id", "r.pattern", "r.score").filter("score IS NOT NULL")
    if hybrid:
        found = found.withColumn("score", F.least(c("score") * 1.1, F.lit(1.0)))
    return found.filter(c("score") >= least - 1e-9)
