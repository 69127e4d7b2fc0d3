"""Front ends: source text to graph nodes, and caller-supplied trees to graph nodes.

`parse` runs a parser on each file, in tasks; files above a size bound or that don't parse give one row in `error`
instead. `from_tree` maps a table of concrete syntax nodes with a table of kinds, all in joins: nodes of unlisted or
skipped kinds hand their children to the nearest kept ancestor.
"""

from __future__ import annotations

import ast
import html.parser
import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.fixpoint import tree_closure

MOST_BYTES = 10 << 20
NODE = "graph_id bigint, path string, node_id bigint, parent bigint, tag string, name string, operator string, literal_kind string, literal string, error string"
FIELDS = ("node_id", "parent", "tag", "name", "operator", "literal_kind", "literal")


class Builder:
    """Rows in pre-order; `open` gives an id to hang children on."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def open(self, parent: int | None, tag: str, name: str | None = None, operator: str | None = None, kind: str | None = None, literal: str | None = None) -> int:
        self.rows.append((len(self.rows), parent, tag, name, operator, kind, literal))
        return len(self.rows) - 1


def parse_json(text: str, out: Builder) -> None:
    """Objects and arrays as literals, pairs as fields."""
    todo = [(json.loads(text, object_pairs_hook=lambda pairs: ("object", pairs)), out.open(None, "Root"))]
    while todo:
        value, parent = todo.pop()
        if isinstance(value, tuple):
            here = out.open(parent, "Literal", kind="Object")
            for key, inner in value[1]:
                todo.append((inner, out.open(here, "Field", key)))
        elif isinstance(value, list):
            here = out.open(parent, "Literal", kind="Array")
            todo += [(x, here) for x in reversed(value)]
        else:
            kind = {type(None): "Null", bool: "Bool", int: "Integer", float: "Float", str: "String"}[type(value)]
            out.open(parent, "Literal", kind=kind, literal=value if isinstance(value, str) else json.dumps(value))


# Elements that never have an end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


def parse_html(text: str, out: Builder) -> None:
    """Elements as unknown kinds named html:TAG, with attributes, texts and comments."""

    class Reader(html.parser.HTMLParser):
        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.open = [("", out.open(None, "Root"))]

        def handle_starttag(self, tag: str, attrs: list) -> None:
            self.handle_startendtag(tag, attrs)
            if tag not in VOID:
                self.open.append((tag, self.last))

        def handle_startendtag(self, tag: str, attrs: list) -> None:
            self.last = out.open(self.open[-1][1], "Unknown", f"html:{tag}")
            for name, _ in attrs:
                out.open(self.last, "Attribute", name)

        def handle_endtag(self, tag: str) -> None:
            if any(t == tag for t, _ in self.open):
                while self.open.pop()[0] != tag:
                    pass

        def handle_data(self, data: str) -> None:
            if data.strip():
                out.open(self.open[-1][1], "Literal", kind="String", literal=data.strip())

        def handle_comment(self, data: str) -> None:
            out.open(self.open[-1][1], "Comment")

    reader = Reader()
    reader.feed(text)
    reader.close()


_SIMPLE = {
    ast.Break: "Break", ast.Continue: "Continue", ast.Return: "Return", ast.Raise: "Throw", ast.Lambda: "Lambda", ast.Await: "Await", ast.Yield: "Yield", ast.YieldFrom: "Yield",
    ast.Call: "Call", ast.Subscript: "IndexAccess",
}
_OPS = {
    ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.FloorDiv: "//", ast.Mod: "%", ast.Pow: "**", ast.LShift: "<<", ast.RShift: ">>", ast.BitAnd: "&", ast.BitOr: "|", ast.BitXor: "^", ast.MatMult: "@",
    ast.Lt: "<", ast.Gt: ">", ast.LtE: "<=", ast.GtE: ">=", ast.Eq: "==", ast.NotEq: "!=", ast.In: "in", ast.NotIn: "not in", ast.Is: "is", ast.IsNot: "is not", ast.And: "and", ast.Or: "or", ast.Not: "not", ast.USub: "-", ast.UAdd: "+", ast.Invert: "~",
}


def parse_python(text: str, out: Builder) -> None:
    """Python through its own parser; bodies become blocks, so that children keep the positions that flow expects."""

    def block(parent: int, body: list) -> list:
        here = out.open(parent, "Block")
        return [(x, here) for x in body]

    def visit(node: ast.AST, parent: int) -> list:
        """Adds one node; returns what is still to be added below it, in order."""
        add = lambda *a, **k: out.open(parent, *a, **k)
        match node:
            case ast.ClassDef():
                return [("block", add("Class", node.name), node.body)]
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                here = add("Function", node.name)
                return [(a, here) for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]] + [("block", here, node.body)]
            case ast.arg():
                add("Parameter", node.arg)
                return []
            case ast.If():
                here = add("If")
                return [(node.test, here), ("block", here, node.body)] + ([("else", here, node.orelse)] if node.orelse else [])
            case ast.While():
                here = add("While")
                return [(node.test, here), ("block", here, node.body)]
            case ast.For() | ast.AsyncFor():
                here = add("For")
                return [(node.target, here), (node.iter, here), ("block", here, node.body)]
            case ast.Match():
                here = add("Match")
                return [(node.subject, here)] + [("arm", here, c.body) for c in node.cases]
            case ast.Try():
                here = add("Try")
                return [("block", here, node.body)] + [("catch", here, h.body) for h in node.handlers] + ([("finally", here, node.finalbody)] if node.finalbody else [])
            case ast.Assign(targets=[target, *_]):
                here = add("Assignment", operator="=")
                return [(target, here), (node.value, here)]
            case ast.AnnAssign():
                here = add("Assignment", operator="=")
                return [(x, here) for x in (node.target, node.value) if x is not None]
            case ast.AugAssign():
                here = add("Assignment", operator=_OPS[type(node.op)] + "=")
                return [(node.target, here), (node.value, here)]
            case ast.BinOp():
                here = add("BinaryOp", operator=_OPS[type(node.op)])
                return [(node.left, here), (node.right, here)]
            case ast.BoolOp():
                here = add("BinaryOp", operator=_OPS[type(node.op)])
                return [(x, here) for x in node.values]
            case ast.Compare():
                here = add("BinaryOp", operator=_OPS[type(node.ops[0])])
                return [(x, here) for x in (node.left, *node.comparators)]
            case ast.UnaryOp():
                return [(node.operand, add("UnaryOp", operator=_OPS[type(node.op)]))]
            case ast.Name():
                add("Identifier", node.id)
                return []
            case ast.Attribute():
                return [(node.value, add("MemberAccess", node.attr))]
            case ast.Constant():
                kind = {bool: "Bool", int: "Integer", float: "Float", str: "String", type(None): "Null"}.get(type(node.value), "Object")
                add("Literal", kind=kind, literal=str(node.value))
                return []
            case ast.Import() | ast.ImportFrom():
                add("Import", getattr(node, "module", None) or node.names[0].name)
                return []
            case ast.Expr():
                return [(node.value, parent)]
        here = add(_SIMPLE.get(type(node), "Unknown"), None if type(node) in _SIMPLE else type(node).__name__)
        return [(x, here) for x in ast.iter_child_nodes(node) if not isinstance(x, (ast.expr_context, ast.operator, ast.cmpop))]

    wrappers = {"else": "Else", "arm": "MatchArm", "catch": "Catch", "finally": "Finally"}
    todo = [(x, 0) for x in reversed(ast.parse(text).body)]
    out.open(None, "Root")
    while todo:
        item = todo.pop()
        if item[0] == "block":
            more = block(item[1], item[2])
        elif isinstance(item[0], str):
            more = block(out.open(item[1], wrappers[item[0]]), item[2])
        else:
            more = visit(*item)
        todo += reversed(more)


PARSERS: dict[str, Callable[[str, Builder], None]] = {"json": parse_json, "html": parse_html, "python": parse_python}
# File name endings.
EXTENSIONS = {"json": "json", "html": "html", "htm": "html", "py": "python", "pyi": "python"}


def language(path: str = "path"):
    """Language by the ending of a path; Unknown if it has none that is known."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    found = None
    for end, name in EXTENSIONS.items():
        found = F.when(ending == end, name) if found is None else found.when(ending == end, name)
    return found.otherwise("Unknown")


def parse(sources: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Nodes (NODE) of files given as (graph_id, path, language, source)."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for graph, path, lang, text in frame[["graph_id", "path", "language", "source"]].itertuples(index=False, name=None):
                out, error = Builder(), None
                if text is None or lang not in PARSERS:
                    error = "no parser" if text is not None else "no source"
                elif len(text.encode()) > most_bytes:
                    error = "too large"
                else:
                    try:
                        PARSERS[lang](text, out)
                    except (ValueError, SyntaxError, RecursionError) as e:
                        out, error = Builder(), f"{type(e).__name__}: {e}"[:200]
                rows = out.rows if error is None else [(None,) * len(FIELDS)]
                part = pd.DataFrame(rows, columns=FIELDS)
                part.insert(0, "path", path)
                part.insert(0, "graph_id", graph)
                yield part.assign(error=error)

    return sources.select("graph_id", "path", "language", "source").mapInPandas(run, NODE)


def tree_edges(nodes: DataFrame) -> DataFrame:
    """AstChild edges of parsed nodes; ids are in pre-order, so they order children."""
    none = F.lit(None).cast("string")
    return nodes.filter("parent IS NOT NULL").select("graph_id", F.col("node_id").alias("edge_id"), F.col("parent").alias("source"), F.col("node_id").alias("target"), F.lit("ast").alias("family"), F.lit("AstChild").alias("kind"), none.alias("subkind"))


def from_tree(cst: DataFrame, mapping: DataFrame, skipped: DataFrame) -> DataFrame:
    """graph_id, node_id, parent, tag, unknown_kind, ordinal of the kept nodes of trees.

    cst: graph_id, node_id, parent, ts_kind; mapping: ts_kind, tag; skipped: ts_kind of kinds that are left out. Kinds
    without a mapping stay, as Unknown with their own name.
    """
    key = F.struct("graph_id", F.col("node_id").alias("n"))
    kept = cst.join(skipped, "ts_kind", "left_anti")
    above = tree_closure(cst.select(key.alias("node"), F.when(F.col("parent").isNotNull(), F.struct("graph_id", F.col("parent").alias("n"))).alias("parent")))
    over = above.select("desc.graph_id", F.col("desc.n").alias("node_id"), F.col("anc.n").alias("above"), "depth")
    nearest = over.join(kept.select("graph_id", F.col("node_id").alias("above")), ["graph_id", "above"], "left_semi").groupBy("graph_id", "node_id").agg(F.min_by("above", "depth").alias("parent"))
    named = kept.drop("parent").join(mapping, "ts_kind", "left").join(nearest, ["graph_id", "node_id"], "left")
    order = W.partitionBy("graph_id", "parent").orderBy("node_id")
    return named.select("graph_id", "node_id", "parent", F.coalesce("tag", F.lit("Unknown")).alias("tag"), F.when(F.col("tag").isNull(), F.col("ts_kind")).alias("unknown_kind"), F.row_number().over(order).cast("bigint").alias("ordinal"))
