import pytest

from sylvagraph.operators import algorithms

NODE = "graph_id bigint, node_id bigint, tag string, name string, operator string, parent bigint, literal_kind string, lit_int bigint, unknown_kind string"


def frames(spark, *specs):
    """One graph for each spec: (tag, name or operator or integer, children...)."""
    nodes, edges = [], []
    for g, spec in enumerate(specs):
        todo, i = [(spec, None)], 0
        while todo:
            (tag, value, *kids), parent = todo.pop(0)
            operator = value if tag in ("BinaryOp", "UnaryOp", "Assignment") else None
            literal = tag == "Literal"
            nodes.append((g, i, tag, None if operator or literal else value, operator, parent, "Integer" if literal else None, value if literal else None, None))
            if parent is not None:
                edges.append((g, len(edges), parent, i, "AstChild"))
            todo += [(k, i) for k in kids]
            i += 1
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, "graph_id bigint, edge_id bigint, source bigint, target bigint, kind string")


def I(n):  # noqa: E743, N802
    return ("Identifier", n)


@pytest.fixture(scope="module")
def found(spark):
    less, assign = ("BinaryOp", "<", I("a"), I("b")), ("Assignment", "=", I("t"), I("u"))
    call = ("Call", None, I("f"), I("x"))
    specs = [
        ("Function", "sort", ("For", None, ("For", None, ("BinaryOp", ">", I("p"), I("q")), assign, assign, assign, ("BinaryOp", "+", I("j"), ("Literal", 1)), ("IndexAccess", None, I("v"))))),
        ("Function", "search", ("Block", None, I("mid"), less, ("If", None, I("c"), ("Return", None, I("c"))), ("Block", None, ("Call", None, I("search"))))),
        ("Function", "walk", ("While", None, I("queue"), I("visited"))),
        ("Function", "plan", ("For", None, ("For", None, I("memo")))),
        ("Function", "idle", ("Block", None)),
        ("Function", "f", ("Block", None, ("If", None, I("c"), ("Return", None, ("Literal", 0))), ("Return", None, call))),
        ("Function", "f", ("Block", None, ("If", None, I("c"), ("Return", None, ("Literal", 0))), ("Return", None, ("BinaryOp", "+", call, call)))),
        ("Function", "deep", ("For", None, ("For", None, ("For", None, ("For", None, I("z")))))),
        ("Function", "scan", ("While", None, less, ("Assignment", "+=", I("k"), ("Literal", 1)), ("Return", None, I("k")))),
    ]
    nodes, edges = frames(spark, *specs)
    est = algorithms.estimates(nodes, edges)
    return {r.graph_id: r for r in est.collect()}, {(r.graph_id, r.family): (r.name, r.confidence) for r in algorithms.families(est).collect()}


def test_complexity(found):
    est, _ = found
    got = {g: (r.time, r.time_power, r.time_confidence, r.recursion, r.space) for g, r in est.items()}
    assert got[0] == ("Quadratic", 0, 0.8, None, "Constant")
    assert got[1] == ("Logarithmic", 0, 0.8, "Direct", "Linear")
    assert got[2] == ("Linear", 0, 0.6, None, "Constant")
    assert got[4] == ("Constant", 0, 0.9, None, "Constant")
    assert got[5][:4] == ("Linear", 0, 0.8, "Tail")
    assert got[6][:4] == ("Exponential", 0, 0.7, "Direct")
    assert got[7][:3] == ("Polynomial", 4, 0.6)
    assert got[8][:3] == ("Linear", 0, 0.8)
    assert est[5].n_base == 1 and est[0].loop_depth == 2


def test_families(found):
    _, fam = found
    assert fam[0, "Sorting"] == ("Bubble Sort", 0.7)
    assert fam[1, "Searching"] == ("Binary Search", 0.8) and fam[1, "DivideAndConquer"] == (None, 0.6)
    assert fam[2, "GraphTraversal"] == ("BFS", 0.7)
    assert fam[3, "DynamicProgramming"] == (None, 0.7)
    assert fam[8, "Searching"] == ("Linear Search", 0.7)
    assert not [k for k in fam if k[0] == 4]
