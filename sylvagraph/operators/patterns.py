"""Design patterns: the catalogue's pattern graphs, matched relaxed and reported by confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import cut
from .matching import Pattern, match

REPORTED = 0.7


def _pattern(name: str, nodes: str, edges: str = "") -> Pattern:
    """nodes: tags; edges: `source>target:kind`."""
    parsed = []
    for e in edges.split():
        ends, _, kind = e.partition(":")
        a, b = ends.split(">")
        parsed.append((int(a), int(b), kind))
    return Pattern(name, tuple(nodes.split()), tuple(parsed))


# Category, confidence and graph of each pattern.
CATALOGUE: dict[str, tuple[str, float, Pattern]] = {
    p.name: (category, confidence, p)
    for category, confidence, p in (
        ("Creational", 0.8, _pattern("singleton", "Class Field Function Function Return", "0>1:AstChild 0>2:AstChild 0>3:AstChild 3>4:AstChild 1>4:DataFlow:FieldRead")),
        ("Creational", 0.7, _pattern("factory_method", "Class Function Class Function", "0>1:AstChild 2>3:AstChild 2>0:Inherits")),
        ("Creational", 0.7, _pattern("abstract_factory", "Trait Function Function Class", "0>1:AstChild 0>2:AstChild 3>0:Implements")),
        ("Creational", 0.7, _pattern("builder", "Class Function Function Function", "0>1:AstChild 0>2:AstChild 0>3:AstChild")),
        ("Creational", 0.8, _pattern("prototype", "Trait Function Class", "0>1:AstChild 2>0:Implements")),
        ("Structural", 0.7, _pattern("adapter", "Trait Class Field Function", "1>0:Implements 1>2:AstChild 1>3:AstChild")),
        ("Structural", 0.7, _pattern("bridge", "Class Trait Field Function", "0>2:AstChild 0>3:AstChild 2>1:TypeOf")),
        ("Structural", 0.7, _pattern("composite", "Trait Function Class Field Function", "0>1:AstChild 2>3:AstChild 2>4:AstChild 2>0:Implements")),
        ("Structural", 0.7, _pattern("decorator", "Trait Class Field Function", "1>0:Implements 1>2:AstChild 1>3:AstChild 2>0:TypeOf")),
        ("Structural", 0.6, _pattern("facade", "Class Field Field Function", "0>1:AstChild 0>2:AstChild 0>3:AstChild")),
        ("Structural", 0.7, _pattern("flyweight", "Trait Function Class Field Function", "0>1:AstChild 2>3:AstChild 2>4:AstChild")),
        ("Structural", 0.7, _pattern("proxy", "Trait Function Class Field", "0>1:AstChild 2>3:AstChild 2>0:Implements")),
        ("Behavioral", 0.7, _pattern("chain_of_responsibility", "Trait Function Function Class Field", "0>1:AstChild 0>2:AstChild 3>4:AstChild 3>0:Implements")),
        ("Behavioral", 0.7, _pattern("command", "Trait Function Class Field", "0>1:AstChild 2>3:AstChild 2>0:Implements")),
        ("Behavioral", 0.7, _pattern("interpreter", "Trait Function Class Class", "0>1:AstChild 2>0:Implements 3>0:Implements")),
        ("Behavioral", 0.8, _pattern("iterator", "Trait Function Function", "0>1:AstChild 0>2:AstChild")),
        ("Behavioral", 0.7, _pattern("mediator", "Trait Function Class Field", "0>1:AstChild 2>3:AstChild 3>0:TypeOf")),
        ("Behavioral", 0.8, _pattern("memento", "Class Field Function Function", "0>1:AstChild 0>2:AstChild 0>3:AstChild")),
        ("Behavioral", 0.8, _pattern("observer", "Class Field Function Function Trait Function", "0>1:AstChild 0>2:AstChild 0>3:AstChild 4>5:AstChild")),
        ("Behavioral", 0.7, _pattern("state", "Trait Function Class Field Function", "0>1:AstChild 2>3:AstChild 2>4:AstChild 3>0:TypeOf")),
        ("Behavioral", 0.7, _pattern("strategy", "Trait Function Class Field Function", "0>1:AstChild 2>3:AstChild 2>4:AstChild 3>0:TypeOf")),
        ("Behavioral", 0.7, _pattern("template_method", "Class Function Function Function", "0>1:AstChild 0>2:AstChild 0>3:AstChild 1>2:CallSite 1>3:CallSite")),
        ("Behavioral", 0.8, _pattern("visitor", "Trait Function Function Trait Function", "0>1:AstChild 0>2:AstChild 3>4:AstChild")),
    )
}


def detect(nodes: DataFrame, edges: DataFrame, names: list[str] | None = None, least: float = REPORTED) -> DataFrame:
    """graph_id, pattern, category, n_matches, confidence of every pattern found with enough confidence."""
    nodes, edges = cut(nodes.select("graph_id", "node_id", "tag")), cut(edges.select("graph_id", "source", "target", "kind", "subkind"))
    found = None
    for name in names or list(CATALOGUE):
        category, confidence, pattern = CATALOGUE[name]
        if confidence < least:
            continue
        counted = match(pattern, nodes, edges, relaxed=True).groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_matches"))
        rows = counted.select("graph_id", F.lit(name).alias("pattern"), F.lit(category).alias("category"), "n_matches", F.lit(confidence).alias("confidence"))
        found = rows if found is None else found.unionByName(rows)
    return found


def confidence(matched: Column, expected: Column, least: Column) -> Column:
    """Of a match of some of a template's nodes: half of the base where none is, the whole base where all are."""
    share = F.when(expected > 0, matched / expected).otherwise(F.lit(0.0))
    return share * least + (1 - share) * 0.5 * least


def catalogue(spark: SparkSession) -> DataFrame:
    """pattern, category, n_nodes, n_edges, confidence: the supported patterns."""
    return spark.createDataFrame([(n, c, len(p.nodes), len(p.edges), x) for n, (c, x, p) in CATALOGUE.items()], "pattern string, category string, n_nodes bigint, n_edges bigint, confidence double")
