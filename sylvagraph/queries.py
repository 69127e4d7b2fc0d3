"""Queries over the relational graph views, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .functions import kinds
from .operators import matching, metrics, patterns, scc, similarity, store, traversal
from .plans.fixpoint import bfs, closure
from .plans.storage import configure
from .sources import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# The views of sources/views.py in SQL.
AST_SQL = """
nodes AS (
  SELECT 0::BIGINT AS node_id, 'Root' AS tag, NULL::BIGINT AS parent
  UNION ALL SELECT 1000000000 + r_regionkey, 'Module', 0 FROM region
  UNION ALL SELECT 2000000000 + n_nationkey, 'Class', 1000000000 + n_regionkey FROM nation
  UNION ALL SELECT 3000000000 + c_custkey, 'Function', 2000000000 + c_nationkey FROM customer
  UNION ALL SELECT 4000000000 + o_orderkey, 'Call', 3000000000 + o_custkey FROM orders)"""
TAG_SQL = "CASE event_type WHEN 'view' THEN 'Block' WHEN 'click' THEN 'Call' WHEN 'purchase' THEN 'Assignment' WHEN 'signup' THEN 'Variable' WHEN 'error' THEN 'Throw' ELSE 'Unknown' END"
EVENTS_SQL = f"""
en AS (SELECT user_id AS graph_id, event_id AS node_id, {TAG_SQL} AS tag, event_type AS name, ts FROM events),
ee AS (SELECT graph_id, source, target FROM (SELECT user_id AS graph_id, event_id AS source, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events) WHERE target IS NOT NULL)"""
TYPES_SQL = """
te AS (SELECT DISTINCT graph_id, source, target FROM (SELECT user_id AS graph_id, event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events) WHERE target IS NOT NULL)"""
CALLS_SQL = """
calls AS (SELECT c_nationkey::BIGINT AS source, s_nationkey::BIGINT AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= {q} AND l_discount < 0.005 AND l_tax < 0.005),
ce AS (SELECT DISTINCT source, target FROM calls)"""
CALLS = CALLS_SQL.format(q=45)


def query(name: str, sql: str | None = None):
    """Registers a query and its SQL."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return put


@query("cyclomatic_per_user", f"""
WITH {TYPES_SQL}, n AS (SELECT graph_id, count(*) AS v FROM (SELECT graph_id, source AS n FROM te UNION SELECT graph_id, target FROM te) GROUP BY graph_id)
SELECT graph_id, greatest(count(*) - any_value(v), 0) + 2 AS cyclomatic FROM te JOIN n USING (graph_id) GROUP BY graph_id""")
def cyclomatic_per_user(spark, sf_dir):
    return store.cyclomatic(views.event_types_cfg(spark, sf_dir).edges)


@query("graph_stats", f"""
WITH {AST_SQL}, {EVENTS_SQL},
touched AS (SELECT graph_id, count(*) AS v FROM (SELECT graph_id, source AS n FROM ee UNION SELECT graph_id, target FROM ee) GROUP BY graph_id),
e AS (SELECT graph_id, count(*) AS n FROM ee GROUP BY graph_id)
SELECT 'events' AS view, en.graph_id, count(*) AS n_nodes, coalesce(any_value(e.n), 0) AS n_edges, 0::BIGINT AS n_functions, 0::BIGINT AS n_classes, 0::BIGINT AS n_ast, coalesce(any_value(e.n), 0) AS n_cfg,
  0::BIGINT AS n_dfg, 0::BIGINT AS n_call, coalesce(greatest(any_value(e.n) - any_value(v), 0) + 2, 1) AS cyclomatic
FROM en LEFT JOIN e USING (graph_id) LEFT JOIN touched USING (graph_id) GROUP BY en.graph_id
UNION ALL SELECT 'ast', 1, count(*), count(parent), count(*) FILTER (tag = 'Function'), count(*) FILTER (tag = 'Class'), count(parent), 0, 0, 0, 1 FROM nodes""")
def graph_stats(spark, sf_dir):
    ast, events = views.tpch_ast(spark, sf_dir), views.events_cfg(spark, sf_dir)
    parts = [store.stats(g.nodes, g.edges).withColumn("view", F.lit(v)) for v, g in (("ast", ast), ("events", events))]
    return parts[0].unionByName(parts[1])


@query("ast_children_order", f"WITH {AST_SQL} SELECT parent, node_id AS child, row_number() OVER (PARTITION BY parent ORDER BY node_id) AS ordinal FROM nodes WHERE parent IS NOT NULL")
def ast_children_order(spark, sf_dir):
    return traversal.children(views.tpch_ast(spark, sf_dir).edges).drop("graph_id")


@query("ast_descendant_counts", f"""
WITH RECURSIVE {AST_SQL}, d AS (SELECT node_id AS seed, node_id FROM nodes WHERE tag = 'Class' UNION ALL SELECT seed, nodes.node_id FROM d JOIN nodes ON nodes.parent = d.node_id)
SELECT seed, count(*) - 1 AS n FROM d GROUP BY seed HAVING count(*) > 1""")
def ast_descendant_counts(spark, sf_dir):
    g = views.tpch_ast(spark, sf_dir)
    return traversal.descendants(g.edges, g.nodes.filter("tag = 'Class'")).groupBy("seed").agg(F.count(F.lit(1)).alias("n"))


@query("ast_ancestors_of_order", f"""
WITH RECURSIVE {AST_SQL}, a AS (SELECT node_id AS desc_, parent AS anc, 1::BIGINT AS depth FROM nodes WHERE tag = 'Call'
  UNION ALL SELECT desc_, nodes.parent, depth + 1 FROM a JOIN nodes ON nodes.node_id = a.anc WHERE nodes.parent IS NOT NULL)
SELECT desc_ AS order_node, anc AS ancestor, depth FROM a""")
def ast_ancestors_of_order(spark, sf_dir):
    g = views.tpch_ast(spark, sf_dir)
    return traversal.ancestors(g.nodes).join(g.nodes.filter("tag = 'Call'").select(F.col("node_id").alias("desc")), "desc", "left_semi").select(F.col("desc").alias("order_node"), F.col("anc").alias("ancestor"), "depth")


@query("ast_depth", f"""
WITH RECURSIVE {AST_SQL}, d AS (SELECT node_id, 1::BIGINT AS depth FROM nodes WHERE parent IS NULL UNION ALL SELECT nodes.node_id, depth + 1 FROM d JOIN nodes ON nodes.parent = d.node_id)
SELECT max(depth) AS depth FROM d""")
def ast_depth(spark, sf_dir):
    return spark.range(1).select(F.lit(traversal.depth(views.tpch_ast(spark, sf_dir).nodes)).cast("bigint").alias("depth"))


@query("nodes_by_kind", f"WITH {AST_SQL}, {EVENTS_SQL} SELECT tag, count(*) AS n FROM (SELECT tag FROM nodes UNION ALL SELECT tag FROM en) GROUP BY tag")
def nodes_by_kind(spark, sf_dir):
    both = views.tpch_ast(spark, sf_dir).nodes.select("tag").unionByName(views.events_cfg(spark, sf_dir).nodes.select("tag"))
    return both.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("node_predicates", f"""
WITH {EVENTS_SQL} SELECT tag, tag IN ('Variable') AS declaration, tag IN ('Throw') AS statement, tag IN ('Call', 'Assignment') AS expression, tag = 'Throw' AS control_flow, count(*) AS n FROM en GROUP BY tag""")
def node_predicates(spark, sf_dir):
    n = views.events_cfg(spark, sf_dir).nodes.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return n.select("tag", kinds.is_declaration().alias("declaration"), kinds.is_statement().alias("statement"), kinds.is_expression().alias("expression"), kinds.is_control_flow().alias("control_flow"), "n")


@query("edges_between", f"WITH {CALLS} SELECT source, target, count(*) AS n FROM calls GROUP BY source, target")
def edges_between(spark, sf_dir):
    return store.between(views.nation_calls(spark, sf_dir).edges).drop("graph_id")


@query("connect_unique", f"WITH {CALLS} SELECT source, target, 0::BIGINT AS added_again FROM ce")
def connect_unique(spark, sf_dir):
    edges = views.nation_calls(spark, sf_dir).edges
    once = store.connect_unique(edges.limit(0), edges)
    again = store.new_edges(once, edges).select("source", "target", F.lit(1).cast("bigint").alias("a"))
    return once.select("source", "target").join(again, ["source", "target"], "left").select("source", "target", F.coalesce("a", F.lit(0).cast("bigint")).alias("added_again"))


@query("dangling_edge_filter", """
SELECT o_custkey AS source, o_orderkey AS target FROM (SELECT CASE WHEN o_orderkey % 7 = 0 THEN -o_custkey ELSE o_custkey END AS o_custkey, o_orderkey FROM orders) WHERE o_custkey IN (SELECT c_custkey FROM customer)""")
def dangling_edge_filter(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders")
    g = F.lit(1).cast("bigint").alias("graph_id")
    edges = orders.select(g, F.when(F.col("o_orderkey") % 7 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("source"), F.col("o_orderkey").alias("target"))
    ids = views.table(spark, sf_dir, "customer").select(g, F.col("c_custkey").alias("node_id")).unionByName(orders.select(g, F.col("o_orderkey").alias("node_id")))
    customers = views.table(spark, sf_dir, "customer").select(g, F.col("c_custkey").alias("source"))
    return store.valid_edges(edges, ids).join(customers, ["graph_id", "source"], "left_semi").select("source", "target")


@query("outgoing_incoming_degree", f"""
WITH {CALLS} SELECT n_nationkey::BIGINT AS node_id, (SELECT count(*) FROM ce WHERE source = n_nationkey) AS n_out, (SELECT count(*) FROM ce WHERE target = n_nationkey) AS n_in FROM nation""")
def outgoing_incoming_degree(spark, sf_dir):
    g = views.nation_calls(spark, sf_dir)
    return store.degrees(g.nodes, g.edges.select("graph_id", "source", "target").distinct()).drop("graph_id")


RANGES_SQL = f"""
rn AS (SELECT graph_id, node_id, tag, (k * 10)::BIGINT AS start, (k * 10 + 5 + node_id % 50)::BIGINT AS "end" FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY ts, node_id) - 1 AS k FROM en)),
ro AS (SELECT DISTINCT graph_id, (start + node_id % 40)::BIGINT AS "offset" FROM rn)"""


def _ranges(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    n = views.events_cfg(spark, sf_dir).nodes
    k = F.row_number().over(W.partitionBy("graph_id").orderBy("ts", "node_id")) - 1
    nodes = n.withColumn("k", k).select("graph_id", "node_id", "tag", (F.col("k") * 10).cast("bigint").alias("start"), (F.col("k") * 10 + 5 + F.col("node_id") % 50).cast("bigint").alias("end"))
    return nodes, nodes.select("graph_id", (F.col("start") + F.col("node_id") % 40).alias("offset")).distinct()


for _name, _tags, _scopes in (("node_at_offset", "", False), ("scope_at_offset", "AND tag IN ('Block', 'Function')", True)):
    SQL[_name] = f"""
WITH {EVENTS_SQL}, {RANGES_SQL} SELECT graph_id, "offset", node_id FROM (
  SELECT ro.graph_id, "offset", node_id, row_number() OVER (PARTITION BY ro.graph_id, "offset" ORDER BY "end" - start, node_id) AS k
  FROM ro JOIN rn ON ro.graph_id = rn.graph_id AND start <= "offset" AND "offset" < "end" {_tags}) WHERE k = 1"""
    QUERIES[_name] = lambda spark, sf_dir, s=_scopes: traversal.at_offset(*_ranges(spark, sf_dir), 64, s)


@query("nodes_in_range", f"""
WITH {EVENTS_SQL}, {RANGES_SQL} SELECT ro.graph_id, "offset" AS range_id, count(*) AS n FROM ro JOIN rn ON ro.graph_id = rn.graph_id AND start < "offset" + 100 AND "end" > "offset" GROUP BY ro.graph_id, "offset" """)
def nodes_in_range(spark, sf_dir):
    nodes, offsets = _ranges(spark, sf_dir)
    ranges = offsets.select("graph_id", F.col("offset").alias("range_id"), F.col("offset").alias("start"), (F.col("offset") + 100).alias("end"))
    return traversal.overlapping(nodes, ranges, 64).groupBy("graph_id", "range_id").agg(F.count(F.lit(1)).alias("n"))


@query("cfg_successors", f"WITH {EVENTS_SQL} SELECT graph_id, source AS node_id, target AS successor, 'Sequential' AS subkind FROM ee")
def cfg_successors(spark, sf_dir):
    return traversal.neighbours(views.events_cfg(spark, sf_dir).edges, "cfg")


@query("cfg_nodes", f"WITH {EVENTS_SQL} SELECT graph_id, node_id, tag FROM en WHERE EXISTS (SELECT 1 FROM ee WHERE ee.graph_id = en.graph_id AND (source = node_id OR target = node_id))")
def cfg_nodes(spark, sf_dir):
    g = views.events_cfg(spark, sf_dir)
    return traversal.incident(g.nodes, g.edges, "cfg").select("graph_id", "node_id", "tag")


@query("basic_block_leaders", f"""
WITH {EVENTS_SQL}, f AS (SELECT graph_id, node_id, lag(tag) OVER (PARTITION BY graph_id ORDER BY ts, node_id) AS before FROM en)
SELECT graph_id, node_id FROM f WHERE before IS NULL OR before = 'Throw'""")
def basic_block_leaders(spark, sf_dir):
    g = views.events_cfg(spark, sf_dir)
    source = g.nodes.select("graph_id", F.col("node_id").alias("source"), F.col("tag").alias("before"))
    into = g.edges.select("graph_id", "source", F.col("target").alias("node_id")).join(source, ["graph_id", "source"])
    return g.nodes.select("graph_id", "node_id").join(into, ["graph_id", "node_id"], "left").filter("before IS NULL OR before = 'Throw'").select("graph_id", "node_id")


DEFINES = "tag IN ('Assignment', 'Variable')"


@query("reaching_definition_latest", f"""
WITH {EVENTS_SQL}, d AS (SELECT *, max(CASE WHEN tag IN ('Assignment', 'Variable') THEN k END) OVER (PARTITION BY graph_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS at
  FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY ts, node_id) AS k FROM en))
SELECT u.graph_id, u.node_id AS use_site, x.node_id AS definition FROM d u JOIN d x ON u.graph_id = x.graph_id AND u.at = x.k WHERE u.tag = 'Call'""")
def reaching_definition_latest(spark, sf_dir):
    before = W.partitionBy("graph_id").orderBy("ts", "node_id").rowsBetween(W.unboundedPreceding, -1)
    n = views.events_cfg(spark, sf_dir).nodes.withColumn("definition", F.last(F.when(F.expr(DEFINES), F.col("node_id")), ignorenulls=True).over(before))
    return n.filter("tag = 'Call' AND definition IS NOT NULL").select("graph_id", F.col("node_id").alias("use_site"), "definition")


@query("reaching_definition_weak", f"""
WITH {EVENTS_SQL} SELECT u.graph_id, u.node_id AS use_site, d.node_id AS definition FROM en u JOIN en d ON u.graph_id = d.graph_id AND u.ts::DATE = d.ts::DATE
WHERE u.tag = 'Call' AND d.tag IN ('Assignment', 'Variable') AND (d.ts, d.node_id) < (u.ts, u.node_id)""")
def reaching_definition_weak(spark, sf_dir):
    n = views.events_cfg(spark, sf_dir).nodes.withColumn("day", F.to_date("ts"))
    before = W.partitionBy("graph_id", "day").orderBy("ts", "node_id").rowsBetween(W.unboundedPreceding, -1)
    all_ = n.withColumn("definition", F.collect_list(F.when(F.expr(DEFINES), F.col("node_id"))).over(before)).filter("tag = 'Call'")
    return all_.select("graph_id", F.col("node_id").alias("use_site"), F.explode("definition").alias("definition"))


@query("def_use_chain", f"""
WITH {EVENTS_SQL}, d AS (SELECT *, max(CASE WHEN tag IN ('Assignment', 'Variable') THEN k END) OVER (PARTITION BY graph_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS at
  FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY ts, node_id) AS k FROM en))
SELECT u.graph_id, x.name AS variable, count(DISTINCT x.node_id) AS n_definitions, count(DISTINCT u.node_id) AS n_uses, count(*) AS n_pairs
FROM d u JOIN d x ON u.graph_id = x.graph_id AND u.at = x.k WHERE u.tag = 'Call' GROUP BY ALL""")
def def_use_chain(spark, sf_dir):
    pairs = reaching_definition_latest(spark, sf_dir)
    names = views.events_cfg(spark, sf_dir).nodes.select("graph_id", F.col("node_id").alias("definition"), F.col("name").alias("variable"))
    return pairs.join(names, ["graph_id", "definition"]).groupBy("graph_id", "variable").agg(F.count_distinct("definition").alias("n_definitions"), F.count_distinct("use_site").alias("n_uses"), F.count(F.lit(1)).alias("n_pairs"))


@query("parameter_edges", """
SELECT a.o_orderkey AS argument, b.c_custkey AS parameter FROM
  (SELECT o_orderkey, c_nationkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders JOIN customer ON o_custkey = c_custkey) a
  JOIN (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer) b ON a.c_nationkey = b.c_nationkey AND a.k = b.k""")
def parameter_edges(spark, sf_dir):
    """Arguments meet the parameters of the same place: orders by customer, customers by nation."""
    customers = views.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    arguments = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("k"))
    parameters = customers.withColumn("k", F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")))
    return arguments.join(parameters, ["c_nationkey", "k"]).select(F.col("o_orderkey").alias("argument"), F.col("c_custkey").alias("parameter"))


@query("callers_callees", f"""
WITH {CALLS} SELECT n_nationkey::BIGINT AS node_id, (SELECT count(DISTINCT target) FROM ce WHERE source = n_nationkey) AS n_callees, (SELECT count(DISTINCT source) FROM ce WHERE target = n_nationkey) AS n_callers FROM nation""")
def callers_callees(spark, sf_dir):
    g = views.nation_calls(spark, sf_dir)
    d = store.degrees(g.nodes, g.edges.select("graph_id", "source", "target").distinct())
    return d.select("node_id", F.col("n_out").alias("n_callees"), F.col("n_in").alias("n_callers"))


@query("call_sites", f"WITH {AST_SQL} SELECT parent AS function_id, count(*) AS n FROM nodes WHERE tag = 'Call' GROUP BY parent")
def call_sites(spark, sf_dir):
    g = views.tpch_ast(spark, sf_dir)
    below = traversal.ancestors(g.nodes)
    calls = g.nodes.filter("tag = 'Call'").select(F.col("node_id").alias("desc"))
    functions = g.nodes.filter("tag = 'Function'").select(F.col("node_id").alias("anc"))
    return below.join(calls, "desc", "left_semi").join(functions, "anc", "left_semi").groupBy(F.col("anc").alias("function_id")).agg(F.count(F.lit(1)).alias("n"))


def _steps(spark, sf_dir) -> DataFrame:
    return views.nation_calls(spark, sf_dir).edges.select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct()


@query("call_reachability", f"WITH RECURSIVE {CALLS}, r AS (SELECT source AS src, target AS dst FROM ce UNION SELECT src, target FROM r JOIN ce ON dst = source) SELECT src, dst FROM r")
def call_reachability(spark, sf_dir):
    return closure(_steps(spark, sf_dir)).select("src", "dst")


REACH = "r AS (SELECT source AS src, target AS dst FROM ce UNION SELECT src, target FROM r JOIN ce ON dst = source)"
SCC_SQL = f"""
m AS (SELECT n_nationkey::BIGINT AS node_id, least(n_nationkey, coalesce((SELECT min(a.dst) FROM r a JOIN r b ON a.dst = b.src AND b.dst = a.src WHERE a.src = n_nationkey), n_nationkey))::BIGINT AS root FROM nation),
k AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS component_id, count(*) AS n_nodes FROM (SELECT root, node_id FROM m) GROUP BY root)"""


@query("call_graph_scc", f"""
WITH RECURSIVE {CALLS}, {REACH}, {SCC_SQL}
SELECT node_id, (dense_rank() OVER (ORDER BY root) - 1)::BIGINT AS component_id, (SELECT count(*) FROM m x WHERE x.root = m.root) > 1 OR EXISTS (SELECT 1 FROM ce WHERE source = node_id AND target = node_id) AS cyclic FROM m""")
def call_graph_scc(spark, sf_dir):
    g = views.nation_calls(spark, sf_dir)
    return scc.components(g.nodes, g.edges).select("node_id", "component_id", "cyclic")


@query("scc_condensation", f"""
WITH RECURSIVE {CALLS}, {REACH}, {SCC_SQL}, d AS (SELECT node_id, (dense_rank() OVER (ORDER BY root) - 1)::BIGINT AS c FROM m)
SELECT DISTINCT a.c AS source, b.c AS target FROM ce JOIN d a ON source = a.node_id JOIN d b ON target = b.node_id WHERE a.c <> b.c""")
def scc_condensation(spark, sf_dir):
    g = views.nation_calls(spark, sf_dir)
    return scc.condensation(scc.components(g.nodes, g.edges), g.edges).select("source", "target")


for _name, _a, _b in (("forward_slice", "source", "target"), ("backward_slice", "target", "source")):
    SQL[_name] = f"""
WITH RECURSIVE {CALLS}, s AS (SELECT n_nationkey::BIGINT AS seed, n_nationkey::BIGINT AS node, 0::BIGINT AS depth FROM nation UNION SELECT seed, {_b}, depth + 1 FROM s JOIN ce ON {_a} = node WHERE depth < 30)
SELECT seed, node, min(depth) AS depth FROM s GROUP BY seed, node"""

    def _slice(spark, sf_dir, a=_a, b=_b):
        g = views.nation_calls(configure(spark), sf_dir)
        return bfs(g.edges.select(F.col(a).alias("src"), F.col(b).alias("dst")), g.nodes.select(F.col("node_id").alias("seed"), F.col("node_id").alias("node")))

    QUERIES[_name] = _slice


@query("induced_subgraph", f"WITH {CALLS} SELECT source, target FROM ce WHERE source IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) AND target IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def induced_subgraph(spark, sf_dir):
    g = views.nation_calls(spark, sf_dir)
    ids = views.table(spark, sf_dir, "nation").filter("n_regionkey < 3").select(F.lit(1).cast("bigint").alias("graph_id"), F.col("n_nationkey").cast("bigint").alias("node_id"))
    return store.subgraph(g.nodes, g.edges, ids)[1].select("source", "target").distinct()


def _matches(name: str, pattern: matching.Pattern, sql: str, relaxed: bool = False) -> None:
    def run(spark, sf_dir):
        g = views.nation_calls(configure(spark), sf_dir)
        return matching.match(pattern, g.nodes, g.edges, relaxed).drop("graph_id")

    QUERIES[name], SQL[name] = run, f"WITH {CALLS} {sql}"


_F = "Function"
_matches("vf2_path3", matching.Pattern("path", (_F, _F, _F), ((0, 1, "StaticCall"), (1, 2, "StaticCall"))), "SELECT a.source AS p0, a.target AS p1, b.target AS p2 FROM ce a JOIN ce b ON a.target = b.source WHERE a.source <> a.target AND b.source <> b.target AND a.source <> b.target")
_matches("vf2_star3", matching.Pattern("star", (_F, _F, _F), ((0, 1, "CallSite"), (0, 2, "DynamicCall"))), "SELECT a.source AS p0, a.target AS p1, b.target AS p2 FROM ce a JOIN ce b ON a.source = b.source WHERE a.source <> a.target AND b.source <> b.target AND a.target <> b.target", True)
_matches("vf2_triangle", matching.Pattern("triangle", (_F, _F, _F), ((0, 1, "StaticCall"), (1, 2, "StaticCall"), (2, 0, "StaticCall"))), "SELECT a.source AS p0, b.source AS p1, c.source AS p2 FROM ce a JOIN ce b ON a.target = b.source JOIN ce c ON b.target = c.source AND c.target = a.source WHERE a.source <> b.source AND b.source <> c.source AND a.source <> c.source")
_matches("vf2_self_loop", matching.Pattern("loop", (_F,), ((0, 0, "StaticCall"),)), "SELECT source AS p0 FROM ce WHERE source = target")

HIST_SQL = f"WITH {EVENTS_SQL}, h AS (SELECT graph_id, tag, count(*) AS n FROM en GROUP BY ALL), t AS (SELECT graph_id, sum(n) AS t, sqrt(sum(n * n)) AS r FROM h GROUP BY ALL), p AS (SELECT a.graph_id AS a, b.graph_id AS b FROM t a JOIN t b ON b.graph_id = a.graph_id + 1)"


def _neighbour_pairs(nodes: DataFrame) -> DataFrame:
    ids = nodes.select("graph_id").distinct()
    return ids.select(F.col("graph_id").alias("a"), (F.col("graph_id") + 1).alias("b")).join(ids.select(F.col("graph_id").alias("b")), "b", "left_semi")


@query("similarity_jaccard", f"{HIST_SQL} SELECT a, b, round(coalesce((SELECT sum(least(x.n, y.n)) FROM h x JOIN h y USING (tag) WHERE x.graph_id = a AND y.graph_id = b), 0) / (SELECT sum(t) - coalesce((SELECT sum(least(x.n, y.n)) FROM h x JOIN h y USING (tag) WHERE x.graph_id = a AND y.graph_id = b), 0) FROM t WHERE graph_id IN (a, b)), 6) AS score FROM p")
def similarity_jaccard(spark, sf_dir):
    n = views.events_cfg(spark, sf_dir).nodes
    return similarity.jaccard(similarity.tag_histogram(n), _neighbour_pairs(n)).withColumn("score", F.round("score", 6))


@query("similarity_cosine", f"{HIST_SQL} SELECT a, b, round(coalesce((SELECT sum(x.n * y.n) FROM h x JOIN h y USING (tag) WHERE x.graph_id = a AND y.graph_id = b), 0) / ((SELECT r FROM t WHERE graph_id = a) * (SELECT r FROM t WHERE graph_id = b)), 6) AS score FROM p")
def similarity_cosine(spark, sf_dir):
    n = views.events_cfg(spark, sf_dir).nodes
    return similarity.cosine(similarity.tag_histogram(n), _neighbour_pairs(n)).withColumn("score", F.round("score", 6))


_WL = ["SELECT graph_id, node_id, tag AS label FROM en"]
WL_SQL = f"WITH {EVENTS_SQL}, u AS (SELECT graph_id, source AS node_id, target AS other FROM ee UNION ALL SELECT graph_id, target, source FROM ee), w0 AS ({_WL[0]})"
for _k in range(3):
    WL_SQL += f""", w{_k + 1} AS (SELECT w.graph_id, w.node_id, md5(any_value(w.label) || '|' || coalesce(string_agg(o.label, ',' ORDER BY o.label), '')) AS label
  FROM w{_k} w LEFT JOIN u ON u.graph_id = w.graph_id AND u.node_id = w.node_id LEFT JOIN w{_k} o ON o.graph_id = u.graph_id AND o.node_id = u.other GROUP BY w.graph_id, w.node_id)"""
WL_SQL += """, h AS (SELECT graph_id, label AS tag, count(*) AS n FROM (SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3 UNION ALL SELECT * FROM w3) GROUP BY ALL),
t AS (SELECT graph_id, sqrt(sum(n * n)) AS r FROM h GROUP BY ALL), p AS (SELECT a.graph_id AS a, b.graph_id AS b FROM t a JOIN t b ON b.graph_id = a.graph_id + 1),
d AS (SELECT a, b, sum(x.n * y.n) AS dot FROM p JOIN h x ON x.graph_id = a JOIN h y ON y.graph_id = b AND x.tag = y.tag GROUP BY a, b)
SELECT a, b, round(coalesce(dot, 0) / ((SELECT r FROM t WHERE graph_id = a) * (SELECT r FROM t WHERE graph_id = b)), 6) AS score FROM p LEFT JOIN d USING (a, b)"""


@query("similarity_wl", WL_SQL)
def similarity_wl(spark, sf_dir):
    g = views.events_cfg(spark, sf_dir)
    hist = similarity.wl_histogram(g.nodes, g.edges)
    return similarity.cosine(hist, _neighbour_pairs(g.nodes)).withColumn("score", F.round("score", 6))


@query("json_literals", """SELECT event_id, 'k' AS key, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def json_literals(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select("event_id", F.lit("k").alias("key"), F.get_json_object("props", "$.k").alias("text")).filter("text IS NOT NULL")
    return e.select("event_id", "key", kinds.parse_integer("text").alias("value"))


@query("parse_integer_literals", "SELECT * FROM (VALUES ('0x_ff', 255::BIGINT), ('0b1_01', 5), ('0o17', 15), ('1_000', 1000), ('99999999999999999999', 0), ('x', 0), ('-7', -7), ('', 0)) t(literal, value)")
def parse_integer_literals(spark, sf_dir):
    rows = spark.createDataFrame([(x,) for x in ("0x_ff", "0b1_01", "0o17", "1_000", "99999999999999999999", "x", "-7", "")], "literal string")
    return rows.select("literal", kinds.parse_integer("literal").alias("value"))


@query("html_tag_histogram", r"""SELECT lower(tag) AS tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM pages) GROUP BY ALL""")
def html_tag_histogram(spark, sf_dir):
    tags = views.table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), 1)).alias("tag"))
    return tags.groupBy(F.lower("tag").alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@query("gnn_pool_by_label", "SELECT label, i - 1 AS dim, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY ALL")
def gnn_pool_by_label(spark, sf_dir):
    e = views.table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return e.groupBy("label", F.col("dim").cast("bigint").alias("dim")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("gnn_message_pass", """
WITH ring AS (SELECT vec_id, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS next FROM embeddings),
u AS (SELECT vec_id, next AS other FROM ring WHERE next IS NOT NULL UNION ALL SELECT next, vec_id FROM ring WHERE next IS NOT NULL UNION ALL SELECT vec_id, vec_id FROM embeddings),
x AS (SELECT u.vec_id, i, sum(e.embedding[i]::DOUBLE) / count(*) AS v FROM u JOIN embeddings e ON e.vec_id = u.other, range(1, 65) r(i) GROUP BY u.vec_id, i)
SELECT vec_id, round(sqrt(sum(greatest(v, 0) * greatest(v, 0))), 5) AS norm FROM x GROUP BY vec_id""")
def gnn_message_pass(spark, sf_dir):
    from .operators import embeddings

    e = views.table(spark, sf_dir, "embeddings").select(F.lit(1).cast("bigint").alias("graph_id"), F.col("vec_id").alias("node_id"), "label", F.col("embedding").cast("array<double>").alias("vector"))
    following = F.lead("node_id").over(W.partitionBy("label").orderBy("node_id"))
    edges = e.select("graph_id", F.col("node_id").alias("source"), following.alias("target")).filter("target IS NOT NULL")
    passed = embeddings.message_pass(e.select("graph_id", "node_id", "vector"), edges, 1, 64)
    return passed.select(F.col("node_id").alias("vec_id"), F.round(embeddings.norm("vector"), 5).alias("norm"))


CLASS_SQL = """
served AS (SELECT c_nationkey::BIGINT AS n, c_mktsegment AS s, min(c_acctbal) AS low, any_value(n_regionkey)::BIGINT AS r FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
by_region AS (SELECT DISTINCT r, s FROM served),
fields AS (SELECT DISTINCT s_nationkey::BIGINT AS n, n_regionkey::BIGINT AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey),
reading AS (SELECT * FROM served WHERE low < 0 AND n IN (SELECT n FROM fields)),
cn AS (SELECT r_regionkey::BIGINT + 1 AS id, 'decl' AS class FROM region UNION ALL SELECT n_nationkey + 100, 'decl' FROM nation UNION ALL SELECT 100000 + n * 1000 + ascii(s), 'decl' FROM served
  UNION ALL SELECT 200000 + r * 1000 + ascii(s), 'decl' FROM by_region UNION ALL SELECT n + 300000, 'decl' FROM fields UNION ALL SELECT 400000 + n * 1000 + ascii(s), 'expr' FROM reading),
e AS (SELECT n_nationkey + 100 AS a, n_regionkey + 1 AS b, 'Implements' AS kind FROM nation UNION ALL SELECT n + 100, 100000 + n * 1000 + ascii(s), 'AstChild' FROM served
  UNION ALL SELECT r + 1, 200000 + r * 1000 + ascii(s), 'AstChild' FROM by_region UNION ALL SELECT n + 100, n + 300000, 'AstChild' FROM fields
  UNION ALL SELECT n + 300000, r + 1, 'TypeOf' FROM fields UNION ALL SELECT 100000 + n * 1000 + ascii(s), 400000 + n * 1000 + ascii(s), 'AstChild' FROM reading),
de AS (SELECT e.* FROM e JOIN cn x ON x.id = a AND x.class = 'decl' JOIN cn y ON y.id = b AND y.class = 'decl')"""


def _pattern_sql(name: str) -> str:
    """Counts of one pattern whose nodes are all declarations; singleton needs a statement, which the view lacks."""
    category, confidence, pattern = patterns.CATALOGUE[name]
    sources, where, of = [], [], {}
    for k, (a, b, kind) in enumerate(pattern.edges):
        sources.append(f"de e{k}")
        where.append(f"e{k}.kind = '{kind}'")
        for node, end in ((a, f"e{k}.a"), (b, f"e{k}.b")):
            if node in of:
                where.append(f"{of[node]} = {end}")
            else:
                where += [f"{end} <> {x}" for x in of.values()]
                of[node] = end
    return f"SELECT '{name}' AS pattern, '{category}' AS category, count(*) AS n_matches, {confidence}::DOUBLE AS confidence FROM {', '.join(sources)} WHERE {' AND '.join(where)} HAVING count(*) > 0"


@query("gof_patterns", f"WITH {CLASS_SQL} " + " UNION ALL ".join(_pattern_sql(n) for n, (_, c, _p) in patterns.CATALOGUE.items() if n != "singleton" and c >= patterns.REPORTED))
def gof_patterns(spark, sf_dir):
    g = views.class_graph(spark, sf_dir)
    return patterns.detect(g.nodes, g.edges).drop("graph_id")


@query("pattern_metrics", f"""
WITH {CLASS_SQL}, m AS (SELECT n, count(*) AS m FROM served GROUP BY n), x AS (SELECT n, count(*) AS x FROM reading GROUP BY n),
l AS (SELECT avg(greatest(m * (m - 1) / 2 - 2 * (coalesce(x, 0) * (coalesce(x, 0) - 1) / 2), 0) / (m * (m - 1) / 2)) AS lcom FROM m JOIN fields USING (n) LEFT JOIN x USING (n) WHERE m >= 2)
SELECT (SELECT count(*) FROM nation) AS class_count, (SELECT count(*) FROM region) AS interface_count, (SELECT count(*) FROM nation) AS inheritance_count, 0::BIGINT AS composition_count,
  round((SELECT count(*) FROM served) / (SELECT count(*) FROM nation), 6) AS avg_methods_per_class, round(lcom, 6) AS cohesion, 1.0::DOUBLE AS coupling FROM l""")
def pattern_metrics(spark, sf_dir):
    g = views.class_graph(spark, sf_dir)
    m = metrics.pattern_metrics(g.nodes, g.edges).drop("graph_id")
    return m.withColumns({c: F.round(c, 6) for c in ("avg_methods_per_class", "cohesion", "coupling")})


@query("similarity_features", f"""
WITH {EVENTS_SQL}, n AS (SELECT graph_id, count(*) AS n FROM en GROUP BY graph_id), e AS (SELECT graph_id, count(*) AS e FROM ee GROUP BY graph_id),
v AS (SELECT graph_id, count(*) AS v FROM (SELECT graph_id, source AS x FROM ee UNION SELECT graph_id, target FROM ee) GROUP BY graph_id),
f AS (SELECT graph_id, [least(n / 1000, 1), least(coalesce(e, 0) / 2000, 1), CASE WHEN e > 0 THEN 1.0 ELSE 0.0 END, 1 / 50, least(coalesce(greatest(e - v, 0) + 2, 1) / 100, 1)]::DOUBLE[] AS f FROM n LEFT JOIN e USING (graph_id) LEFT JOIN v USING (graph_id))
SELECT x.graph_id AS a, y.graph_id AS b, round(least(list_cosine_similarity(x.f, y.f), 1), 6) AS score FROM f x JOIN f y ON y.graph_id = x.graph_id + 1""")
def similarity_features(spark, sf_dir):
    g = views.events_cfg(spark, sf_dir)
    found = similarity.feature_cosine(similarity.feature_vectors(store.stats(g.nodes, g.edges)), _neighbour_pairs(g.nodes))
    return found.withColumn("score", F.round("score", 6))
