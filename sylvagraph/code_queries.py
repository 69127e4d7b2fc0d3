"""Queries of flow, slicing, loops, classes and languages over the synthetic program of sources/code.py.

The SQL states, shape by shape, which edges, events and exits must come out, so it shares nothing with the operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import kinds, languages, literals
from .operators import algorithms, classify, embeddings, flow, patterns, scc, similarity, store, traversal
from .queries import QUERIES, SQL, query
from .sources import code

__all__ = ["QUERIES", "SQL"]


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in rows) + ")"


CODE_SQL = f"""
sh AS (SELECT * FROM {_values([(k, *n[:5], n[5], n[6]) for k, shape in enumerate(code.SHAPES) for n in shape])} AS t(shape, ofs, up, tag, name, operator, literal_kind, lit_int)),
fn AS (SELECT c_custkey AS c, c_custkey // 10 AS g, c_custkey * 1000 AS f, c_custkey - c_custkey % 2 AS callee FROM customer),
st AS (SELECT *, f + 10 * j AS b, (c + 3 * j) % 8 AS shape FROM (SELECT *, unnest(range(1, 2 + c % 6)) AS j FROM fn)),
cn AS (SELECT g, f, f AS n, 'Function' AS tag, 'f' || c AS name, NULL AS parent FROM fn UNION ALL SELECT g, f, f + 1, 'Parameter', 'p', f FROM fn UNION ALL SELECT g, f, f + 2, 'Block', NULL, f FROM fn
  UNION ALL SELECT g, f, b + ofs, tag, CASE name WHEN 'callee' THEN 'f' || callee ELSE name END, CASE WHEN up < 0 THEN f + 2 ELSE b + up END FROM st JOIN sh USING (shape))"""
#: What each shape gives: control flow inside it, its exits, and its uses and definitions in order (loops twice).
INNER = (
    (0, 0, 1, "Sequential"), (0, 2, 3, "Sequential"),
    (1, 0, 1, "Sequential"), (1, 1, 2, "ConditionalTrue"), (1, 2, 3, "Sequential"), (1, 1, 6, "ConditionalFalse"),
    (2, 0, 1, "Sequential"), (2, 1, 2, "ConditionalTrue"), (2, 2, 3, "Sequential"), (2, 3, 4, "Sequential"), (2, 5, 1, "LoopBack"),
    (3, 0, 2, "ConditionalTrue"), (3, 2, 3, "Sequential"), (3, 3, 4, "Sequential"), (3, 4, 5, "ConditionalTrue"), (3, 5, 0, "Break"), (3, 4, 0, "LoopBack"),
    (4, 0, 1, "Sequential"), (4, 1, 2, "Sequential"), (4, 2, 5, "ConditionalTrue"), (4, 5, 2, "LoopBack"), (4, 2, 3, "Sequential"), (4, 3, 0, "Continue"), (4, 1, 0, "LoopBack"),
    (5, 0, 1, "Sequential"), (5, 1, 2, "Case"), (5, 2, 4, "Sequential"), (5, 1, 5, "Case"), (5, 5, 6, "Sequential"), (5, 6, 7, "Sequential"),
    (6, 0, 1, "Sequential"), (6, 1, 2, "Sequential"), (6, 2, 3, "Sequential"), (6, 2, 4, "Throw"), (6, 1, 7, "Sequential"), (6, 4, 5, "Sequential"), (6, 5, 6, "Sequential"), (6, 6, 7, "Sequential"), (6, 7, 8, "Sequential"),
    (7, 0, 1, "Sequential"), (7, 1, 2, "Sequential"), (7, 1, 3, "Sequential"),
)
EXITS = ((0, 3), (1, 4), (1, 6), (2, 1), (3, 0), (3, 5), (5, 4), (5, 8), (6, 8), (7, 0))
EVENTS = (
    (0, 1, "use", "p", 3), (0, 2, "strong", "a", 0),
    (1, 1, "use", "a", 1), (1, 2, "use", "a", 4), (1, 3, "weak", "b", 2),
    (2, 1, "use", "b", 6), (2, 2, "use", "b", 4), (2, 3, "use", "p", 5), (2, 4, "weak", "b", 3), (2, 5, "use", "b", 6), (2, 6, "use", "b", 4), (2, 7, "use", "p", 5), (2, 8, "weak", "b", 3),
    (3, 1, "weak", "i", 1), (3, 2, "use", "i", 4), (3, 3, "weak", "i", 1), (3, 4, "use", "i", 4),
    (4, 1, "weak", "i", 4),
    (5, 1, "use", "a", 1), (5, 2, "use", "a", 4), (5, 3, "use", "a", 7),
    (6, 1, "use", "b", 3), (6, 2, "use", "a", 8),
    (7, 1, "use", "p", 3),
)
CFG_SQL = f"""{CODE_SQL},
inn AS (SELECT * FROM {_values(INNER)} AS t(shape, x, y, subkind)), ex AS (SELECT * FROM {_values(EXITS)} AS t(shape, x)),
cfg AS (SELECT g, f, f AS source, f + 2 AS target, 'Sequential' AS subkind FROM fn UNION ALL SELECT g, f, f + 2, b, 'Sequential' FROM st WHERE j = 1
  UNION ALL SELECT g, f, b + x, b + y, subkind FROM st JOIN inn USING (shape)
  UNION ALL SELECT s.g, s.f, s.b + x, n.b, 'Sequential' FROM st s JOIN st n ON n.f = s.f AND n.j = s.j + 1 JOIN ex ON ex.shape = s.shape WHERE s.shape <> 7
  UNION ALL SELECT g, f, b + 1, callee * 1000, 'Call' FROM st WHERE shape = 7)"""
DFG_SQL = f"""{CODE_SQL},
tv AS (SELECT * FROM {_values(EVENTS)} AS t(shape, k, what, name, ofs)),
ev AS (SELECT f, g, 0 AS seq, 'strong' AS what, 'p' AS name, f + 1 AS n FROM fn UNION ALL SELECT f, g, j * 100 + k, what, name, b + ofs FROM st JOIN tv USING (shape)),
du AS (SELECT DISTINCT u.g, u.f, d.n AS source, u.n AS target FROM ev u JOIN ev d ON d.f = u.f AND d.name = u.name AND d.seq < u.seq AND d.what <> 'use'
  WHERE u.what = 'use' AND NOT EXISTS (SELECT 1 FROM ev s WHERE s.f = u.f AND s.name = u.name AND s.what = 'strong' AND s.seq > d.seq AND s.seq < u.seq)),
rt AS (SELECT g, callee * 1000 AS f, b + 1 AS call, b + 2 AS arg FROM st WHERE shape = 7),
dfg AS (SELECT g, f, source, target, 'DefUse' AS subkind FROM du UNION ALL SELECT g, f, arg, f + 1, 'Parameter' FROM rt
  UNION ALL SELECT s.g, s.f, s.b + 1, rt.call, 'ReturnValue' FROM st s JOIN rt ON rt.f = s.f WHERE s.shape = 7
  UNION ALL SELECT g, f, b + 3, b + 2, 'FieldRead' FROM st WHERE shape = 0 UNION ALL SELECT g, f, b + 7, b + 6, 'IndexRead' FROM st WHERE shape = 5 UNION ALL SELECT g, f, b + 8, b + 6, 'DataDependency' FROM st WHERE shape = 5)"""
# Post-dominance as: the exit (-1) can't be reached without a node.
PDG_SQL = f"""RECURSIVE {DFG_SQL}, {CFG_SQL.replace(CODE_SQL + ",", "")},
fl AS (SELECT DISTINCT f, source AS a, target AS b FROM cfg WHERE subkind <> 'Call'),
rc AS (SELECT f, f AS n FROM fn UNION SELECT fl.f, fl.b FROM rc JOIN fl ON fl.f = rc.f AND fl.a = rc.n),
la AS (SELECT f, max(j) AS j, bool_or(shape = 7) AS returns FROM st GROUP BY f),
xs AS (SELECT st.f, b + x AS n FROM st JOIN la USING (f) JOIN ex USING (shape) WHERE CASE WHEN returns THEN st.shape = 7 ELSE st.j = la.j END
  UNION SELECT st.f, st.f + 2 FROM st JOIN la USING (f) WHERE NOT returns AND st.j = la.j AND st.shape = 4),
f0 AS (SELECT fl.f, a, b FROM fl JOIN rc ON rc.f = fl.f AND rc.n = fl.a
  UNION SELECT rc.f, rc.n, -1 FROM rc LEFT JOIN fl ON fl.f = rc.f AND fl.a = rc.n LEFT JOIN xs ON xs.f = rc.f AND xs.n = rc.n LEFT JOIN cn ON cn.n = rc.n WHERE fl.a IS NULL OR xs.n IS NOT NULL OR cn.tag IN ('Return', 'Throw')),
ld AS (SELECT f, -1::BIGINT AS n FROM fn UNION SELECT f0.f, f0.a FROM ld JOIN f0 ON f0.f = ld.f AND f0.b = ld.n),
fo AS (SELECT * FROM f0 UNION SELECT rc.f, rc.n, -1 FROM rc LEFT JOIN ld USING (f, n) WHERE ld.n IS NULL),
av AS (SELECT fo.f, rc.n AS m, a AS n FROM fo JOIN rc ON rc.f = fo.f AND rc.n <> a WHERE b = -1 UNION SELECT av.f, av.m, fo.a FROM av JOIN fo ON fo.f = av.f AND fo.b = av.n AND fo.a <> av.m),
pd AS (SELECT x.f, x.n, y.n AS m FROM rc x JOIN rc y USING (f) LEFT JOIN av ON av.f = x.f AND av.m = y.n AND av.n = x.n WHERE av.n IS NULL),
br AS (SELECT f, a FROM fo GROUP BY f, a HAVING count(DISTINCT b) > 1),
cd AS (SELECT DISTINCT fo.f, fo.a AS source, pd.m AS target FROM fo JOIN br USING (f, a) JOIN pd ON pd.f = fo.f AND pd.n = fo.b LEFT JOIN pd own ON own.f = fo.f AND own.n = fo.a AND own.m = pd.m WHERE (own.m IS NULL OR own.m = fo.a) AND fo.f IN (SELECT f FROM f0 WHERE b = -1)),
pdg AS (SELECT f // 10000 AS g, f, source, target, 'ControlDependence' AS kind FROM cd UNION ALL SELECT g, f, source, target, 'DataDependence' FROM du)"""


def _code(spark, sf_dir):
    g = code.customer_code(spark, sf_dir)
    return g.nodes, g.edges


def _flow(spark, sf_dir, family: str):
    nodes, edges = _code(spark, sf_dir)
    found = flow.extract(nodes, edges).filter(F.col("family") == family)
    return nodes, edges, found


@query("cfg_edges", f"WITH {CFG_SQL} SELECT DISTINCT g AS graph_id, source, target, subkind FROM cfg")
def cfg_edges(spark, sf_dir):
    return _flow(spark, sf_dir, "cfg")[2].select("graph_id", "source", "target", "subkind")


@query("cfg_marks", f"""WITH {CFG_SQL}, la AS (SELECT f, max(j) AS j, bool_or(shape = 7) AS returns FROM st GROUP BY f)
SELECT g AS graph_id, f AS function_id, f AS node_id, 'entry' AS mark FROM fn UNION ALL SELECT DISTINCT st.g, st.f, b + x, 'exit' FROM st JOIN la USING (f) JOIN ex USING (shape) WHERE CASE WHEN returns THEN st.shape = 7 ELSE st.j = la.j END
UNION ALL SELECT g, st.f, st.f + 2, 'exit' FROM st JOIN la USING (f) WHERE NOT returns AND st.j = la.j AND st.shape = 4""")
def cfg_marks(spark, sf_dir):
    return flow.marks(*_code(spark, sf_dir))


@query("cfg_neighbours", f"WITH {CFG_SQL}, d AS (SELECT DISTINCT source, target, subkind FROM cfg), o AS (SELECT source AS n, count(*) AS n_out FROM d GROUP BY source), i AS (SELECT target AS n, count(*) AS n_in FROM d GROUP BY target) SELECT n AS node_id, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in FROM o FULL JOIN i USING (n)")
def cfg_neighbours(spark, sf_dir):
    both = _flow(spark, sf_dir, "cfg")[2]
    out = both.groupBy(F.col("source").alias("node_id")).agg(F.count(F.lit(1)).alias("n_out"))
    into = both.groupBy(F.col("target").alias("node_id")).agg(F.count(F.lit(1)).alias("n_in"))
    return out.join(into, "node_id", "full").na.fill(0).select("node_id", "n_out", "n_in")


@query("cfg_edge_classes", f"WITH {CFG_SQL} SELECT subkind, subkind IN ('ConditionalTrue', 'ConditionalFalse', 'Case') AS conditional, subkind IN ('LoopBack', 'Break', 'Continue') AS loop, subkind = 'Throw' AS exception, count(*) AS n FROM (SELECT DISTINCT source, target, subkind FROM cfg) GROUP BY subkind")
def cfg_edge_classes(spark, sf_dir):
    n = _flow(spark, sf_dir, "cfg")[2].groupBy("subkind").agg(F.count(F.lit(1)).alias("n"))
    return n.select("subkind", kinds.is_conditional().alias("conditional"), kinds.is_loop().alias("loop"), kinds.is_exception().alias("exception"), "n")


@query("dfg_edge_classes", f"WITH {DFG_SQL} SELECT subkind, subkind IN ('DefUse', 'FieldRead', 'IndexRead') AS read, FALSE AS write, TRUE AS forward, 'dfg' AS family, count(*) AS n FROM (SELECT DISTINCT source, target, subkind FROM dfg) GROUP BY subkind")
def dfg_edge_classes(spark, sf_dir):
    n = _flow(spark, sf_dir, "dfg")[2].groupBy("kind", "subkind").agg(F.count(F.lit(1)).alias("n"))
    return n.select("subkind", kinds.is_read().alias("read"), kinds.is_write().alias("write"), kinds.is_forward().alias("forward"), kinds.family().alias("family"), "n")


@query("edge_families", f"WITH {CFG_SQL} SELECT 'ast' AS family, count(*) AS n FROM cn WHERE parent IS NOT NULL UNION ALL SELECT 'call', count(*) FROM st WHERE shape = 7 UNION ALL SELECT 'cfg', count(*) FROM (SELECT DISTINCT source, target, subkind FROM cfg)")
def edge_families(spark, sf_dir):
    nodes, edges = _code(spark, sf_dir)
    new = flow.extract(nodes, edges).filter("kind = 'ControlFlow'").select("kind")
    return edges.select("kind").unionByName(new).select(kinds.family().alias("family")).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


@query("code_elements", f"WITH {CODE_SQL} SELECT n AS node_id, tag, name FROM cn WHERE tag IN ('Function', 'Variable', 'Call', 'Class')")
def code_elements(spark, sf_dir):
    return _code(spark, sf_dir)[0].filter(F.col("tag").isin("Function", "Variable", "Call", "Class")).select("node_id", "tag", "name")


@query("code_parents", f"WITH {CODE_SQL} SELECT g AS graph_id, n AS node_id, parent FROM cn WHERE parent IS NOT NULL")
def code_parents(spark, sf_dir):
    return traversal.parents(_code(spark, sf_dir)[0])


@query("graph_roots", f"WITH {CODE_SQL} SELECT g AS graph_id, min(n) AS root, count(*) AS n_nodes FROM cn GROUP BY g")
def graph_roots(spark, sf_dir):
    nodes, _ = _code(spark, sf_dir)
    return store.root(nodes).join(nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_nodes")), "graph_id")


@query("basic_blocks", f"""WITH RECURSIVE {CFG_SQL}, d AS (SELECT DISTINCT source, target, subkind FROM cfg),
le AS (SELECT f AS n FROM fn UNION SELECT target FROM d WHERE subkind IN ('ConditionalTrue', 'ConditionalFalse', 'Case', 'LoopBack', 'Break', 'Continue') UNION SELECT target FROM d JOIN cn ON cn.n = d.source WHERE tag IN ('If', 'While', 'For', 'Loop', 'Match', 'Return', 'Break', 'Continue')),
lo AS (SELECT source, min(target) AS target FROM d GROUP BY source HAVING count(*) = 1 AND min(subkind) = 'Sequential'),
ch AS (SELECT n AS leader, n, 0::BIGINT AS position FROM le UNION ALL SELECT leader, target, position + 1 FROM ch JOIN lo ON lo.source = ch.n WHERE target NOT IN (SELECT n FROM le))
SELECT leader // 10000 AS graph_id, leader, n AS node_id, position FROM ch""")
def basic_blocks(spark, sf_dir):
    nodes, _, cfg = _flow(spark, sf_dir, "cfg")
    return flow.basic_blocks(nodes, cfg)


@query("dfg_edges", f"WITH {DFG_SQL} SELECT DISTINCT g AS graph_id, source, target, subkind FROM dfg")
def dfg_edges(spark, sf_dir):
    return _flow(spark, sf_dir, "dfg")[2].select("graph_id", "source", "target", "subkind")


@query("def_use_chains", f"WITH {DFG_SQL} SELECT du.g AS graph_id, name, source AS definition, target AS use FROM du JOIN cn ON cn.n = du.target")
def def_use_chains(spark, sf_dir):
    nodes, _, found = _flow(spark, sf_dir, "dfg")
    return flow.chains(found, nodes)


@query("definitions_of_uses", f"WITH {DFG_SQL} SELECT use, count(*) AS n_definitions, min(definition) AS first_definition FROM (SELECT source AS definition, target AS use FROM du) GROUP BY use")
def definitions_of_uses(spark, sf_dir):
    nodes, _, found = _flow(spark, sf_dir, "dfg")
    return flow.chains(found, nodes).groupBy("use").agg(F.count(F.lit(1)).alias("n_definitions"), F.min("definition").alias("first_definition"))


@query("uses_of_definitions", f"WITH {DFG_SQL} SELECT source AS definition, count(*) AS n_uses, max(target) AS last_use FROM du GROUP BY source")
def uses_of_definitions(spark, sf_dir):
    nodes, _, found = _flow(spark, sf_dir, "dfg")
    return flow.chains(found, nodes).groupBy("definition").agg(F.count(F.lit(1)).alias("n_uses"), F.max("use").alias("last_use"))


@query("return_edges", f"WITH {DFG_SQL} SELECT DISTINCT source, target FROM dfg WHERE subkind = 'ReturnValue'")
def return_edges(spark, sf_dir):
    return _flow(spark, sf_dir, "dfg")[2].filter("subkind = 'ReturnValue'").select("source", "target")


@query("pdg_edges", f"WITH {PDG_SQL} SELECT DISTINCT g AS graph_id, source, target, kind FROM pdg")
def pdg_edges(spark, sf_dir):
    return _flow(spark, sf_dir, "pdg")[2].select("graph_id", "source", "target", "kind")


def _slice_sql(backward: bool, criteria: str) -> str:
    a, b = ("target", "source") if backward else ("source", "target")
    return f"""WITH {PDG_SQL}, e AS (SELECT DISTINCT source, target FROM pdg),
sl AS (SELECT n AS criterion, n, 0::BIGINT AS depth FROM cn WHERE {criteria} UNION SELECT criterion, e.{b}, depth + 1 FROM sl JOIN e ON e.{a} = sl.n WHERE depth < 40),
m AS (SELECT criterion, n, min(depth) AS depth FROM sl GROUP BY criterion, n), o AS (SELECT *, row_number() OVER (PARTITION BY criterion ORDER BY depth, n) AS k FROM m)
SELECT criterion, n AS node_id, depth FROM o WHERE k <= 12"""


@query("function_slices", _slice_sql(False, "tag = 'Parameter'"))
def function_slices(spark, sf_dir):
    nodes, _, pdg = _flow(spark, sf_dir, "pdg")
    return flow.slices(pdg, nodes.filter("tag = 'Parameter'"), most=12).drop("graph_id")


@query("call_slices", _slice_sql(True, "tag = 'Return'"))
def call_slices(spark, sf_dir):
    nodes, _, pdg = _flow(spark, sf_dir, "pdg")
    return flow.slices(pdg, nodes.filter("tag = 'Return'"), True, most=12).drop("graph_id")


@query("function_scope", f"WITH {CODE_SQL} SELECT g AS graph_id, f AS function_id, n AS node_id FROM cn")
def function_scope(spark, sf_dir):
    return traversal.function_scope(*_code(spark, sf_dir))


_KEPT = "(n = f OR tag IN ('If', 'While', 'For', 'Loop', 'Match', 'Break', 'Continue', 'Return', 'Throw', 'Try', 'BinaryOp', 'Assignment', 'Call', 'MemberAccess', 'IndexAccess', 'Identifier', 'Literal'))"


@query("function_cfg", f"WITH {CFG_SQL}, k AS (SELECT f, n FROM cn WHERE {_KEPT}), e AS (SELECT DISTINCT f, source, target, subkind FROM cfg), i AS (SELECT e.f, count(*) AS n_edges FROM e JOIN k x ON x.f = e.f AND x.n = source JOIN k y ON y.f = e.f AND y.n = target GROUP BY e.f) SELECT f AS function_id, count(*) AS n_nodes, coalesce(any_value(n_edges), 0) AS n_edges FROM k LEFT JOIN i USING (f) GROUP BY f")
def function_cfg(spark, sf_dir):
    nodes, edges, cfg = _flow(spark, sf_dir, "cfg")
    kept, _ = traversal.function_cfg(nodes, edges)
    among = traversal._among(kept, cfg.select("graph_id", "source", "target", "subkind"))
    sizes = kept.groupBy("function_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    return sizes.join(among.groupBy("function_id").agg(F.count(F.lit(1)).alias("n_edges")), "function_id", "left").na.fill(0).select("function_id", "n_nodes", "n_edges")


@query("function_dfg", f"WITH {DFG_SQL}, x AS (SELECT source AS n FROM dfg UNION SELECT target FROM dfg) SELECT f AS function_id, n AS node_id FROM cn WHERE n <> f AND n IN (SELECT n FROM x)")
def function_dfg(spark, sf_dir):
    nodes, edges, dfg = _flow(spark, sf_dir, "dfg")
    every = edges.select("graph_id", "source", "target", "kind").unionByName(dfg.select("graph_id", "source", "target", "kind"))
    return traversal.function_dfg(nodes, every)[0].select("function_id", "node_id")


@query("control_flow_scc", f"""WITH RECURSIVE {CFG_SQL}, e AS (SELECT DISTINCT f, source, target FROM cfg WHERE target // 1000 = f // 1000),
r AS (SELECT f, source AS a, target AS b FROM e UNION SELECT r.f, a, target FROM r JOIN e ON e.f = r.f AND e.source = r.b),
m AS (SELECT x.a, min(x.b) AS root, count(*) AS n_nodes FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a)
SELECT f AS function_id, n AS node_id, coalesce(least(root, n), n) AS root, coalesce(n_nodes, 1) AS n_nodes, m.a IS NOT NULL AS cyclic FROM cn LEFT JOIN m ON m.a = cn.n""")
def control_flow_scc(spark, sf_dir):
    nodes, edges, cfg = _flow(spark, sf_dir, "cfg")
    return scc.control_flow_components(nodes, edges, cfg).select("function_id", "node_id", "root", "n_nodes", "cyclic")


@query("code_call_graph", f"WITH {CODE_SQL} SELECT DISTINCT f AS source, callee * 1000 AS target FROM st WHERE shape = 7")
def code_call_graph(spark, sf_dir):
    nodes, edges, cfg = _flow(spark, sf_dir, "cfg")
    columns = ["graph_id", "source", "target", "kind", "subkind"]
    return scc.call_graph(nodes, edges.select(*columns).unionByName(cfg.select(*columns))).select("source", "target")


@query("call_graph_flags", f"WITH {CODE_SQL}, s AS (SELECT g, f, bool_or(shape = 7 AND callee = c) AS self FROM st GROUP BY g, f) SELECT g AS graph_id, count(*) FILTER (self) = 0 AS acyclic, count(*) FILTER (self) AS self_cycles, 0::BIGINT AS larger_cycles FROM s GROUP BY g")
def call_graph_flags(spark, sf_dir):
    nodes, edges = _code(spark, sf_dir)
    return scc.flags(scc.components(nodes.filter("tag = 'Function'"), scc.call_graph(nodes, edges)))


@query("loop_depth", f"""WITH {CODE_SQL}, l AS (SELECT * FROM (VALUES (2, 0, 'While', 1, TRUE), (3, 0, 'For', 1, TRUE), (4, 0, 'Infinite', 1, FALSE), (4, 2, 'For', 2, TRUE)) AS t(shape, ofs, kind, depth, counted))
SELECT f AS function_id, b + ofs AS node_id, kind, depth::BIGINT AS depth, counted FROM st JOIN l USING (shape)""")
def loop_depth(spark, sf_dir):
    return algorithms.loops(*_code(spark, sf_dir)).select("function_id", "node_id", "kind", F.col("depth").cast("bigint").alias("depth"), "counted")


# In the program, a call of oneself is always returned (a tail call), and only shape 4 nests loops.
ESTIMATE_SQL = f"""{CODE_SQL},
q AS (SELECT f, count(*) FILTER (shape IN (2, 3)) + 2 * count(*) FILTER (shape = 4) AS n_loops, max(CASE shape WHEN 4 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 0 END) AS depth, bool_or(shape = 4) AS uncounted,
  count(*) FILTER (shape = 7 AND callee = c) AS n_self, bool_or(shape = 2) AS compares, count(*) FILTER (shape IN (0, 1, 2)) AS n_assign, bool_or(shape = 5) AS indexes FROM st GROUP BY f),
es AS (SELECT *, CASE depth WHEN 0 THEN CASE WHEN n_self > 0 THEN 'Linear' ELSE 'Constant' END WHEN 1 THEN 'Linear' ELSE 'Quadratic' END AS time,
  CASE depth WHEN 0 THEN CASE WHEN n_self > 0 THEN 0.8 ELSE 0.9 END WHEN 1 THEN 0.8 ELSE 0.5 END::DOUBLE AS time_confidence FROM q)"""


@query("complexity_rank", f"""WITH {ESTIMATE_SQL} SELECT f AS function_id, CASE WHEN n_self > 0 THEN 'Tail' END AS recursion, time, time_confidence, CASE time WHEN 'Constant' THEN 0 WHEN 'Linear' THEN 2 ELSE 4 END::DOUBLE AS rank,
  'Constant' AS space, CASE WHEN n_self > 0 THEN 0.6 ELSE 0.7 END::DOUBLE AS space_confidence FROM es""")
def complexity_rank(spark, sf_dir):
    est = algorithms.estimates(*_code(spark, sf_dir))
    return est.select("function_id", "recursion", "time", "time_confidence", algorithms.rank("time", "time_power").alias("rank"), "space", "space_confidence")


@query("algorithm_families", f"""WITH {ESTIMATE_SQL}
SELECT f AS function_id, 'Sorting' AS family, CASE WHEN n_assign >= 3 THEN 'Selection Sort' WHEN indexes THEN 'Insertion Sort' END AS name, CASE WHEN n_assign >= 3 OR indexes THEN 0.6 ELSE 0.5 END::DOUBLE AS confidence FROM es WHERE n_loops > 0 AND compares AND time = 'Quadratic'
UNION ALL SELECT f, 'Searching', NULL, 0.5::DOUBLE FROM es WHERE compares AND time = 'Linear'""")
def algorithm_families(spark, sf_dir):
    return algorithms.families(algorithms.estimates(*_code(spark, sf_dir))).select("function_id", "family", "name", "confidence")


CLASSES_SQL = f"""
k AS (SELECT c_custkey AS c, c_custkey // 10 AS g FROM customer),
mt AS (SELECT c, k, {list(code.METHOD_NAMES)!r}[((c + k) % 6 + 1)::INT] AS name, k % 2 = 0 AS static FROM (SELECT c, unnest(range(0, c % 4 + 1)) AS k FROM k)),
m AS (SELECT c, count(*) AS methods, count(*) FILTER (static) AS statics, count(*) FILTER (name IN ('create_one', 'new')) AS factories, count(*) FILTER (name IN ('notify_all', 'update')) AS observers,
  max((name = 'new' AND c % 3 = 0)::INT) AS private_new, max((static AND name = 'get_instance')::INT) AS getter FROM mt GROUP BY c),
ft AS (SELECT c, methods::BIGINT AS method_count, (c % 3)::BIGINT AS field_count, (c % 2 = 0)::BIGINT AS interface_count, statics::BIGINT AS static_method_count, private_new, factories::BIGINT AS factory_method_count, observers::BIGINT AS observer_method_count,
  (c % 3 = 2 AND c % 2 = 0)::BIGINT AS interface_field_count, getter, (c % 3 > 0)::INT AS instance_field FROM m)"""


@query("classifier_features", f"WITH {CLASSES_SQL} SELECT c * 100 AS class_id, method_count, field_count, interface_count, static_method_count, private_new AS has_private_constructor, factory_method_count, observer_method_count, interface_field_count, getter AS has_get_instance, instance_field AS has_instance_field, round(method_count / greatest(field_count, 1), 6) AS method_field_ratio, round(static_method_count / greatest(method_count, 1), 6) AS static_share FROM ft")
def classifier_features(spark, sf_dir):
    g = code.customer_classes(spark, sf_dir)
    f = classify.features(g.nodes, g.edges).filter("class_id < 10000000000")
    names = ("class_id", "method_count", "field_count", "interface_count", "static_method_count", "has_private_constructor", "factory_method_count", "observer_method_count", "interface_field_count", "has_get_instance", "has_instance_field")
    return f.select(*names, F.round("method_field_ratio", 6).alias("method_field_ratio"), F.round("static_share", 6).alias("static_share"))


RULES_SQL = f"""{CLASSES_SQL},
sc AS (SELECT *, CASE WHEN getter > 0 THEN 0.4 ELSE 0 END + CASE WHEN instance_field > 0 THEN 0.3 ELSE 0 END + CASE WHEN private_new > 0 THEN 0.2 ELSE 0 END + CASE WHEN static_method_count > 0 AND method_count <= 5 THEN 0.1 ELSE 0 END AS single FROM ft),
ru AS (SELECT c, 'Singleton' AS pattern, single AS score FROM sc WHERE single >= 0.5 UNION ALL SELECT c, 'Factory', 0.5 + least(factory_method_count * 0.1, 0.4) FROM sc WHERE factory_method_count >= 2 UNION ALL SELECT c, 'Factory', 0.6 FROM sc WHERE factory_method_count = 1 AND method_count <= 3
  UNION ALL SELECT c, 'Observer', 0.5 + least(observer_method_count * 0.15, 0.4) FROM sc WHERE observer_method_count >= 2 UNION ALL SELECT c, 'Strategy', 0.6 + least(interface_field_count * 0.1, 0.3) FROM sc WHERE interface_field_count >= 1 AND interface_count = 0 UNION ALL SELECT c, 'Decorator', 0.75 FROM sc WHERE interface_field_count > 0)"""


@query("classifier_rules", f"WITH {RULES_SQL} SELECT c * 100 AS class_id, pattern, round(score::DOUBLE, 6) AS score FROM ru WHERE score >= 0.7 - 1e-9")
def classifier_rules(spark, sf_dir):
    g = code.customer_classes(spark, sf_dir)
    return classify.scores(classify.features(g.nodes, g.edges)).filter("class_id < 10000000000").select("class_id", "pattern", F.round("score", 6).alias("score"))


@query("classifier_hybrid", f"WITH {RULES_SQL} SELECT c * 100 AS class_id, pattern, round(least(score * 1.1, 1)::DOUBLE, 6) AS score FROM ru WHERE least(score * 1.1, 1) >= 0.7 - 1e-9")
def classifier_hybrid(spark, sf_dir):
    g = code.customer_classes(spark, sf_dir)
    return classify.scores(classify.features(g.nodes, g.edges), hybrid=True).filter("class_id < 10000000000").select("class_id", "pattern", F.round("score", 6).alias("score"))


@query("similarity_edit", f"""WITH {CODE_SQL}, n AS (SELECT g, count(*) AS n, count(parent) AS e FROM cn GROUP BY g), k AS (SELECT g, count(*) AS e FROM st WHERE shape = 7 GROUP BY g), s AS (SELECT g, n, n.e + coalesce(k.e, 0) AS e FROM n LEFT JOIN k USING (g)),
h AS (SELECT g, tag, count(*) AS n FROM cn GROUP BY g, tag), c AS (SELECT x.g AS a, sum(least(x.n, y.n)) AS c FROM h x JOIN h y ON y.g = x.g + 1 AND y.tag = x.tag GROUP BY x.g)
SELECT x.g AS a, y.g AS b, round(0.7 * (0.6 * (1 - abs(x.n - y.n) / greatest(x.n, y.n, 1)) + 0.4 * (1 - abs(x.e - y.e) / greatest(x.e, y.e, 1))) + 0.3 * c / (x.n + y.n - c), 6) AS score FROM s x JOIN s y ON y.g = x.g + 1 JOIN c ON c.a = x.g""")
def similarity_edit(spark, sf_dir):
    nodes, edges = _code(spark, sf_dir)
    ids = nodes.select("graph_id").distinct()
    pairs = ids.select(F.col("graph_id").alias("a"), (F.col("graph_id") + 1).alias("b")).join(ids.select(F.col("graph_id").alias("b")), "b", "left_semi")
    return similarity.similarity("edit", nodes, edges, pairs).select("a", "b", F.round("score", 6).alias("score"))


SLOT_SQL = "CASE WHEN tag = 'Function' THEN 3 WHEN tag = 'Variable' THEN 4 WHEN tag IN ('If', 'While', 'For', 'Loop') THEN 5 WHEN tag IN ('Return', 'Break', 'Continue') THEN 6 WHEN tag = 'Call' THEN 7 WHEN tag = 'BinaryOp' THEN 8 WHEN tag = 'Assignment' THEN 9 WHEN tag = 'Identifier' THEN 10 WHEN tag = 'Literal' THEN 11 WHEN tag = 'Block' THEN 12 WHEN tag = 'Parameter' THEN 13 WHEN tag IN ('Try', 'Catch', 'Throw') THEN 14 ELSE 15 END"


@query("initial_embeddings", f"""WITH {CODE_SQL}, x AS (SELECT n, {SLOT_SQL} AS slot, unnest(range(0, 20)) AS i FROM cn)
SELECT n AS node_id, round(sum((i + 1) * ((((n * 7919 + i * 104729 + (n % 1009) * i * 31 + 3) % 65537) / 65537 * 0.2 - 0.1) + CASE WHEN i = slot THEN 1 ELSE 0 END)), 6) AS checksum, any_value(slot)::INT AS slot FROM x GROUP BY n""")
def initial_embeddings(spark, sf_dir):
    e = embeddings.initial(_code(spark, sf_dir)[0], 20, 3)
    total = F.lit(0.0)
    for i in range(20):
        total = total + F.get("embedding", F.lit(i)) * (i + 1)
    return e.select("node_id", F.round(total, 6).alias("checksum"), "slot")


@query("subgraph_embedding", f"WITH {CODE_SQL} SELECT g AS graph_id, round(avg(((n * 7919 + 3) % 65537) / 65537 * 0.2 - 0.1), 6) AS first FROM cn GROUP BY g")
def subgraph_embedding(spark, sf_dir):
    e = embeddings.initial(_code(spark, sf_dir)[0], 20, 3)
    return embeddings.mean_vector(e, ["graph_id"], 20, "embedding").select("graph_id", F.round(F.col("vector")[0], 6).alias("first"))


@query("pattern_confidence", "WITH x AS (SELECT c_custkey AS c, (c_custkey % 6)::DOUBLE AS m, (c_custkey % 4)::DOUBLE AS e FROM customer) SELECT c, round(CASE WHEN e > 0 THEN m / e ELSE 0 END * 0.8 + (1 - CASE WHEN e > 0 THEN m / e ELSE 0 END) * 0.4, 6) AS confidence FROM x")
def pattern_confidence(spark, sf_dir):
    c = code.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"))
    return c.select("c", F.round(patterns.confidence(F.col("c") % 6, F.col("c") % 4, F.lit(0.8)), 6).alias("confidence"))


LANGUAGE_SQL = f"""x AS (SELECT * FROM {_values([(k, e, n) for k, v in languages.EXTENSIONS.items() for n, e in enumerate(v.split())])} AS t(language, extension, position))"""


@query("language_by_extension", f"""WITH {LANGUAGE_SQL}, p AS (SELECT p_partkey, string_split('rs py JS .go .Java txt KT md', ' ')[(p_partkey % 8 + 1)::INT] AS e FROM part)
SELECT p_partkey, coalesce(language, 'Unknown') AS language, coalesce(language IN ('Rust', 'Go'), FALSE) AS systems, coalesce(language IN ('Java', 'Kotlin'), FALSE) AS jvm, coalesce(language IN ('Python', 'JavaScript'), FALSE) AS scripting, coalesce(language = 'Markdown', FALSE) AS markup,
  CASE language WHEN 'Rust' THEN 3 WHEN 'Python' THEN 3 WHEN 'JavaScript' THEN 3 WHEN 'Go' THEN 2 WHEN 'Java' THEN 2 ELSE 0 END AS n_paradigms FROM p LEFT JOIN x ON extension = lower(ltrim(e, '.'))""")
def language_by_extension(spark, sf_dir):
    endings = F.array(*[F.lit(x) for x in "rs py JS .go .Java txt KT md".split()])
    p = code.table(spark, sf_dir, "part").select("p_partkey", languages.from_extension(F.element_at(endings, (F.col("p_partkey") % 8 + 1).cast("int"))).alias("language"))
    groups = [languages.in_group(F.col("language"), g).alias(g) for g in ("systems", "jvm", "scripting", "markup")]
    return p.select("p_partkey", "language", *groups, F.size(languages.paradigms(F.col("language"))).alias("n_paradigms"))


@query("language_extensions", f"WITH {LANGUAGE_SQL} SELECT language, count(*) AS n, min(extension) AS first FROM x GROUP BY language")
def language_extensions(spark, sf_dir):
    return languages.extensions(spark).groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.min("extension").alias("first"))


#: A few kinds of each grammar, with what they stand for.
GRAMMAR = """Rust function_item Function;Rust let_declaration Variable;Rust match_expression Match;Rust match_arm MatchArm;Rust field_expression MemberAccess;Rust macro_invocation Macro;Rust use_declaration Import;Rust type_item TypeAnnotation
Python function_definition Function;Python module Root;Python attribute MemberAccess;Python subscript IndexAccess;Python elif_clause Else;Python raise_statement Throw;Python decorator Attribute;Python none Literal
JavaScript arrow_function Lambda;JavaScript do_statement Loop;JavaScript update_expression UnaryOp;JavaScript lexical_declaration Variable;JavaScript for_of_statement For;JavaScript member_expression MemberAccess;JavaScript switch_default MatchArm
Go defer_statement Finally;Go go_statement Await;Go selector_expression MemberAccess;Go type_declaration Struct;Go interface_type Trait;Go short_var_declaration Variable;Go package_clause Module;Go func_literal Lambda
Java method_invocation Call;Java enhanced_for_statement For;Java try_with_resources_statement Try;Java constructor_declaration Function;Java marker_annotation Attribute;Java interface_declaration Trait;Java array_access IndexAccess
Cpp compound_statement Block;Cpp translation_unit Root;Cpp class_specifier Class;Cpp preproc_include Import;Cpp case_statement MatchArm;Cpp declaration Variable;Cpp field_expression MemberAccess;Cpp number_literal Literal
Ruby unless If;Ruby case Match;Ruby when MatchArm;Ruby do_block Lambda;Ruby rescue Catch;Ruby ensure Finally;Ruby next Continue;Ruby element_reference IndexAccess;Ruby module Module
Json pair Field;Json object Literal;Html comment Comment;Html attribute Attribute;Css rule_set Block;Css declaration Variable;Css class_name Identifier;Bash command Call;Bash case_statement Match;Bash case_item MatchArm;Bash until_statement While
Yaml block_mapping_pair Field;Toml pair Field;Markdown atx_heading Block;Markdown link Import;Rholang contract Function;Rholang ifElse If;Rust no_such_kind Unknown""".replace("\n", ";")
GRAMMAR_ROWS = [tuple(x.split()) for x in GRAMMAR.split(";")]


@query("grammar_kinds", f"WITH k AS (SELECT *, row_number() OVER (ORDER BY language, kind) - 1 AS i FROM {_values(GRAMMAR_ROWS)} AS t(language, kind, tag)) SELECT p_partkey, language, kind, tag FROM part JOIN k ON i = p_partkey % (SELECT count(*) FROM k)")
def grammar_kinds(spark, sf_dir):
    rows = [(i, *x[:2]) for i, x in enumerate(sorted(GRAMMAR_ROWS))]
    known = spark.createDataFrame(rows, "i bigint, language string, kind string")
    p = code.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % len(rows)).alias("i")).join(F.broadcast(known), "i")
    return p.select("p_partkey", "language", "kind", languages.node_kind(F.col("language"), F.col("kind")).alias("tag"))


@query("source_scalars", r"""WITH x AS (SELECT p_partkey, p_name AS t, p_partkey % 7 AS a, p_partkey % 11 AS b FROM part)
SELECT p_partkey, (p_partkey % 1000) / 100 AS float, substr(t, 1, 1) AS char, CASE WHEN b > a THEN substr(t, (a + 1)::INT, (b - a)::INT) ELSE '' END AS text, greatest(b - a, 0) AS length, a >= b AS empty,
  CASE p_partkey % 4 WHEN 0 THEN '+' WHEN 1 THEN 'and' WHEN 2 THEN '?' ELSE '<=' END AS operator, CASE p_partkey % 3 WHEN 0 THEN 'Public' WHEN 1 THEN 'Private' ELSE 'Package' END AS visibility, p_partkey % 5 AS suffixed FROM x""")
def source_scalars(spark, sf_dir):
    k, t = F.col("p_partkey"), F.col("p_name")
    p = code.table(spark, sf_dir, "part").select(k.cast("bigint").alias("p_partkey"), "p_name")
    operands = F.array(F.lit("name"), F.when(k % 4 == 0, "+").when(k % 4 == 1, "and").when(k % 4 == 2, "word").otherwise("<="))
    modifiers = F.array(F.when(k % 3 == 0, "public").when(k % 3 == 1, "private").otherwise("final"))
    digits = F.concat(F.floor(k % 1000 / 100).cast("string"), F.lit("."), F.lpad((k % 100).cast("string"), 2, "0"))
    return p.select(
        "p_partkey", literals.parse_float(F.concat(F.lit("0_"), digits)).alias("float"), literals.parse_char(F.concat(F.lit("'"), t, F.lit("'"))).alias("char"),
        literals.node_text(t, (k % 7).cast("int"), (k % 11).cast("int")).alias("text"), literals.span_length(k % 7, k % 11).alias("length"), literals.span_is_empty(k % 7, k % 11).alias("empty"),
        literals.operator_of(operands).alias("operator"), literals.java_visibility(modifiers).alias("visibility"), literals.leading_integer(F.concat((k % 5).cast("string"), F.lit("u32"))).alias("suffixed"),
    )


@query("function_signatures", r"""WITH x AS (SELECT c_custkey AS c FROM customer) SELECT c, 'f' || c AS name, CASE WHEN c % 2 = 0 THEN 'int' END AS return_type, c % 3 = 0 AS is_static, c % 3 = 1 AS is_async, CASE WHEN c % 5 = 0 THEN 'Public' ELSE 'Private' END AS visibility, c % 4 = 0 AS docstring FROM x""")
def function_signatures(spark, sf_dir):
    c = F.col("c")
    t = code.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"))
    fields = F.when(c % 2 == 0, F.create_map(F.lit("name"), F.concat(F.lit("f"), c.cast("string")), F.lit("return_type"), F.lit("int"))).otherwise(F.create_map(F.lit("name"), F.concat(F.lit("f"), c.cast("string"))))
    modifiers = F.array(F.when(c % 3 == 0, "static").when(c % 3 == 1, "async").otherwise("final"))
    seen = F.array(F.when(c % 5 == 0, "visibility_modifier").otherwise("identifier"))
    s = t.select("c", literals.signature(fields, modifiers, literals.rust_visibility(seen)).alias("s"), literals.is_docstring(F.when(c % 4 == 0, '"""doc').otherwise("x = 1")).alias("docstring"))
    return s.select("c", "s.name", "s.return_type", "s.is_static", "s.is_async", "s.visibility", "docstring")
