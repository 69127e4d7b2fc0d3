from collections import Counter

from sylvagraph.operators.flow import extract
from sylvagraph.sources import frontends
from sylvagraph.streaming import ingest

SOURCES = "graph_id bigint, path string, language string, source string"


def tags(spark, language, text):
    rows = frontends.parse(spark.createDataFrame([(1, "p", language, text)], SOURCES)).collect()
    return rows


def test_json(spark):
    rows = tags(spark, "json", '{"a": 1, "b": 1.5, "c": "s", "d": true, "e": false, "f": null, "g": [1], "h": {}}')
    assert Counter((r.tag, r.literal_kind) for r in rows) == {("Root", None): 1, ("Field", None): 8, ("Literal", "Object"): 2, ("Literal", "Array"): 1, ("Literal", "Integer"): 2, ("Literal", "Float"): 1, ("Literal", "String"): 1, ("Literal", "Bool"): 2, ("Literal", "Null"): 1}
    assert all(r.parent is None or r.parent < r.node_id for r in rows)


def test_html(spark):
    rows = tags(spark, "html", "<div id=x><br/><!-- c --><p>text<br>more</p></div><i>")
    assert Counter(r.tag for r in rows) == {"Root": 1, "Unknown": 5, "Attribute": 1, "Comment": 1, "Literal": 2}
    names = {r.node_id: r.name for r in rows}
    assert [names[r.parent] for r in rows if r.tag == "Literal"] == ["html:p", "html:p"]


def test_python_with_flow(spark):
    text = "def f(n):\n    n = n + 1\n    while n < 9:\n        if n == 3:\n            break\n        n += 1\n    return n\n"
    nodes = frontends.parse(spark.createDataFrame([(1, "p.py", "python", text)], SOURCES))
    assert {"Function", "Parameter", "While", "If", "Break", "Return", "Assignment", "BinaryOp"} <= {r.tag for r in nodes.collect()}
    new = extract(nodes, frontends.tree_edges(nodes)).collect()
    kinds = {r.subkind for r in new if r.family == "cfg"}
    assert {"Sequential", "ConditionalTrue", "LoopBack", "Break"} <= kinds
    names = {r.node_id: (r.tag, r.operator) for r in nodes.collect()}
    assert ("Parameter", None) in {names[r.source] for r in new if r.subkind == "DefUse"}


def test_errors_are_rows(spark):
    rows = [(1, "a", "json", "{"), (2, "b", "cobol", "x"), (3, "c", "python", "def"), (4, "d", "json", None), (5, "e", "json", "[" * 9)]
    got = {r.graph_id: r.error for r in frontends.parse(spark.createDataFrame(rows, SOURCES), 8).collect()}
    assert got[2] == "no parser" and got[4] == "no source" and got[5] == "too large" and got[1] and got[3]


def test_from_tree_hoists_children_of_skipped_nodes(spark):
    cst = spark.createDataFrame([(1, 0, None, "source_file"), (1, 1, 0, "wrapper"), (1, 2, 1, "wrapper"), (1, 3, 2, "function_item"), (1, 4, 1, "odd"), (1, 5, 3, "block")], "graph_id bigint, node_id bigint, parent bigint, ts_kind string")
    mapping = spark.createDataFrame([("source_file", "Root"), ("function_item", "Function"), ("block", "Block")], "ts_kind string, tag string")
    got = frontends.from_tree(cst, mapping, spark.createDataFrame([("wrapper",)], "ts_kind string"))
    assert {(r.node_id, r.parent, r.tag, r.unknown_kind, r.ordinal) for r in got.collect()} == {(0, None, "Root", None, 1), (3, 0, "Function", None, 1), (4, 0, "Unknown", "odd", 2), (5, 3, "Block", None, 1)}


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"k": 1}')
    for name in ("a.json", "b.py"):
        if name == "b.py":
            (folder / name).write_text("x = 1\n")
        ingest.follow(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {r.path.rsplit("/", 1)[1]: r["count"] for r in got.groupBy("path").count().collect()} == {"a.json": 4, "b.py": 4}
