"""Hand-made graphs with known answers, and laws on random ones."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sylvagraph.functions import kinds
from sylvagraph.operators import embeddings, matching, scc, similarity, store, traversal
from sylvagraph.plans.fixpoint import bfs, closure, tree_closure

NODE = "graph_id bigint, node_id bigint, tag string, name string, parent bigint"
EDGE = "graph_id bigint, edge_id bigint, source bigint, target bigint, family string, kind string, subkind string"


def edges_of(spark, pairs, kind="StaticCall", family="call", graph=1):
    return spark.createDataFrame([(graph, k, a, b, family, kind, None) for k, (a, b) in enumerate(pairs)], EDGE)


def nodes_of(spark, ids, tag="Function", graph=1):
    return spark.createDataFrame([(graph, i, tag, f"n{i}", None) for i in ids], NODE)


def test_stats(spark):
    nodes = spark.createDataFrame([(1, 0, "Function", "f", None), (1, 1, "Block", None, 0), (1, 2, "Class", "C", None), (1, 3, "Call", None, 1), (1, 4, "Variable", "v", 1), (1, 5, "Identifier", "x", 1)], NODE)
    rows = [(0, 1, "ast", "AstChild", None), (1, 3, "ast", "AstChild", None), (1, 4, "ast", "AstChild", None), (1, 5, "ast", "AstChild", None), (0, 1, "cfg", "ControlFlow", "Sequential"), (4, 5, "dfg", "DataFlow", "DefUse"), (3, 0, "call", "CallSite", None)]
    edges = spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], EDGE)
    r = store.stats(nodes, edges).first().asDict()
    assert r == {"graph_id": 1, "n_nodes": 6, "n_functions": 1, "n_classes": 1, "n_edges": 7, "n_ast": 4, "n_cfg": 1, "n_dfg": 1, "n_call": 1, "cyclomatic": 2}


def test_dense_flow_has_complexity_four(spark):
    edges = edges_of(spark, [(0, 1), (1, 2), (2, 0), (0, 2), (1, 0)], "ControlFlow", "cfg")
    assert store.cyclomatic(edges).first()["cyclomatic"] == 4


def test_connect_unique_is_idempotent_with_null_subkinds(spark):
    edges = edges_of(spark, [(0, 1), (0, 1), (1, 2)])
    once = store.connect_unique(edges.limit(0), edges)
    assert once.count() == 2
    assert store.connect_unique(once, edges).count() == 2


def test_valid_edges_and_degrees(spark):
    nodes, edges = nodes_of(spark, [0, 1, 2]), edges_of(spark, [(0, 1), (1, 9), (9, 1), (1, 2)])
    valid = store.valid_edges(edges, nodes)
    assert {(r.source, r.target) for r in valid.collect()} == {(0, 1), (1, 2)}
    assert {(r.node_id, r.n_out, r.n_in) for r in store.degrees(nodes, valid).collect()} == {(0, 1, 0), (1, 1, 1), (2, 0, 1)}


def test_children_keep_edge_order(spark):
    edges = edges_of(spark, [(0, 5), (0, 3), (0, 4)], "AstChild", "ast")
    assert [r.child for r in traversal.children(edges).orderBy("ordinal").collect()] == [5, 3, 4]


def test_tree_closure_stops_at_dangling_parents_and_cycles(spark):
    chain = spark.createDataFrame([(k, k - 1 if k else -7) for k in range(9)] + [(20, 21), (21, 20)], "node bigint, parent bigint")
    got = {(r.anc, r.desc): r.depth for r in tree_closure(chain).collect()}
    assert got == {(a, d): d - a for d in range(9) for a in range(d)} | {(20, 21): 1, (21, 20): 1}


def test_bfs_and_closure_on_a_cycle(spark):
    steps = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3)], "src bigint, dst bigint")
    seeds = spark.createDataFrame([(0, 0)], "seed bigint, node bigint")
    assert {r.node: r.depth for r in bfs(steps, seeds).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}
    assert {r.node for r in bfs(steps, seeds, 1).collect()} == {0, 1}
    assert {(r.src, r.dst) for r in closure(steps).collect()} == {(a, b) for a in (0, 1, 2) for b in range(4)}


def test_offsets(spark):
    rows = [(1, 0, "Function", 0, 100), (1, 1, "Block", 10, 50), (1, 2, "Call", 20, 30), (1, 3, "Identifier", 20, 30)]
    nodes = spark.createDataFrame(rows, "graph_id bigint, node_id bigint, tag string, start bigint, end bigint")
    offsets = spark.createDataFrame([(1, o) for o in (0, 10, 25, 30, 60, 100)], "graph_id bigint, offset bigint")
    assert {r.offset: r.node_id for r in traversal.at_offset(nodes, offsets, 16).collect()} == {0: 0, 10: 1, 25: 2, 30: 1, 60: 0}
    assert {r.offset: r.node_id for r in traversal.at_offset(nodes, offsets, 16, True).collect()}[25] == 1
    ranges = spark.createDataFrame([(1, 7, 28, 60)], "graph_id bigint, range_id bigint, start bigint, end bigint")
    assert sorted(r.node_id for r in traversal.overlapping(nodes, ranges, 16).collect()) == [0, 1, 2, 3]


def reach(n, pairs):
    got = [{a} for a in range(n)]
    for _ in range(n):
        for a, b in pairs:
            for s in got:
                if a in s:
                    s.add(b)
    return got


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 8).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)), max_size=2 * n))))
def test_strong_components_against_reachability(case):
    n, pairs = case
    got, reached = scc.strong_components(range(n), pairs), reach(n, pairs)
    assert got == {a: min(b for b in range(n) if b in reached[a] and a in reached[b]) for a in range(n)}


@pytest.mark.parametrize("small", [1_000_000, 0])
def test_components_by_task_and_by_rounds(spark, small):
    rnd = random.Random(5)
    pairs = [(rnd.randrange(12), rnd.randrange(12)) for _ in range(16)] + [(3, 3)]
    nodes, edges = nodes_of(spark, range(12)), edges_of(spark, pairs)
    got = scc.components(nodes, edges, small)
    reached = reach(12, pairs)
    expected = {a: min(b for b in range(12) if b in reached[a] and a in reached[b]) for a in range(12)}
    assert {r.node_id: r.root for r in got.collect()} == expected
    assert all(r.cyclic == (r.n_nodes > 1 or (r.node_id, r.node_id) in pairs) for r in got.collect())
    ranks = {root: k for k, root in enumerate(sorted(set(expected.values())))}
    assert {r.node_id: r.component_id for r in got.collect()} == {a: ranks[r] for a, r in expected.items()}
    links = {(ranks[expected[a]], ranks[expected[b]]) for a, b in pairs if expected[a] != expected[b]}
    assert {(r.source, r.target) for r in scc.condensation(got, edges).collect()} == links


@pytest.mark.parametrize(("shape", "sizes"), [("path", [1] * 1000), ("ring", [1000]), ("clusters", [8] * 125)])
def test_call_graph_shapes(spark, shape, sizes):
    n = 1000
    pairs = {"path": [(k, k + 1) for k in range(n - 1)], "ring": [(k, (k + 1) % n) for k in range(n)], "clusters": [(k, k // 8 * 8 + (k + 1) % 8) for k in range(n)]}[shape]
    got = scc.components(nodes_of(spark, range(n)), edges_of(spark, pairs)).select("root", "n_nodes").distinct().collect()
    assert sorted(r.n_nodes for r in got) == sizes


def test_diamond_has_two_embeddings(spark):
    nodes, edges = nodes_of(spark, range(4), "If"), edges_of(spark, [(0, 1), (0, 2), (1, 3), (2, 3)])
    path = matching.Pattern("path", ("If",) * 3, ((0, 1, "StaticCall"), (1, 2, "StaticCall")))
    assert {(r.p0, r.p1, r.p2) for r in matching.match(path, nodes, edges).collect()} == {(0, 1, 3), (0, 2, 3)}
    assert matching.match(path, nodes, edges, most=1).count() == 1
    two = matching.Pattern("apart", ("If", "If"))
    assert matching.match(two, nodes, edges).count() == 12
    loop = matching.Pattern("loop", ("If",), ((0, 0, "StaticCall"),))
    assert matching.match(loop, nodes, edges).count() == 0


def test_relaxed_finds_at_least_what_strict_finds(spark):
    nodes = spark.createDataFrame([(1, 0, "Class", "", None), (1, 1, "Function", "", None), (1, 2, "Field", "", None)], NODE)
    edges = edges_of(spark, [(0, 1), (0, 2)], "AstChild", "ast")
    pattern = matching.Pattern("member", ("Class", "Function"), ((0, 1, "AstChild"),))
    strict = {(r.p0, r.p1) for r in matching.match(pattern, nodes, edges).collect()}
    relaxed = {(r.p0, r.p1) for r in matching.match(pattern, nodes, edges, True).collect()}
    assert strict == {(0, 1)} and relaxed == {(0, 1), (0, 2)}


def test_similarity_of_graphs(spark):
    rows = [(1, k, "If", "", None) for k in range(3)] + [(2, k, "If", "", None) for k in range(3)] + [(3, 0, "Call", "", None)]
    nodes = spark.createDataFrame(rows, NODE)
    pairs = spark.createDataFrame([(1, 2), (1, 3), (8, 9)], "a bigint, b bigint")
    hist = similarity.tag_histogram(nodes)
    assert {(r.a, r.b): r.score for r in similarity.jaccard(hist, pairs).collect()} == {(1, 2): 1.0, (1, 3): 0.0, (8, 9): 1.0}
    assert {(r.a, r.b): round(r.score, 9) for r in similarity.cosine(hist, pairs).collect()} == {(1, 2): 1.0, (1, 3): 0.0, (8, 9): 0.0}
    wl = similarity.wl_histogram(nodes, edges_of(spark, [(0, 1), (1, 2)], graph=1).unionByName(edges_of(spark, [(0, 1), (1, 2)], graph=2)))
    assert {round(r.score, 9) for r in similarity.cosine(wl, pairs.filter("a = 1 AND b = 2")).collect()} == {1.0}
    assert {r.graph_id: r.n for r in wl.groupBy("graph_id").sum("n").toDF("graph_id", "n").collect()} == {1: 12, 2: 12, 3: 4}


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [4.0, 3.0])], "a array<double>, b array<double>, c array<double>")
    r = df.select(embeddings.norm("a").alias("n"), embeddings.cosine("a", "b").alias("z"), embeddings.cosine("a", "c").alias("c"), embeddings.distance("a", "c").alias("d")).first()
    assert (r.n, r.z, round(r.c, 9), round(r.d, 9)) == (5.0, 0.0, 0.96, round(2**0.5, 9))


def test_integer_literals(spark):
    df = spark.createDataFrame([(x,) for x in ("0xFF", "1_0", "0b11", "0o7", "", "abc", "0x", "99999999999999999999")], "t string")
    assert [r.v for r in df.select(kinds.parse_integer("t").alias("v")).collect()] == [255, 10, 3, 7, 0, 0, 0, 0]
