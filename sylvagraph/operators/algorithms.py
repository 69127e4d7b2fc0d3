"""Loops, recursion, complexity estimates and algorithm families of all functions at once.

Two walks (down from functions, up from loops, returns and calls) give every cue as a conditional aggregate by function;
the estimates are Column expressions over that row.

nodes: graph_id, node_id, tag, name, operator, parent, literal_kind, lit_int, unknown_kind; edges as elsewhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import bfs
from ..plans.storage import cut

LEAST = 0.5
# Tags, operators and name cues.
LOOPS = ("For", "While", "Loop")
GUARDS = ("If", "Match", "MatchArm")
COMPARISONS = ("<", ">", "<=", ">=", "==", "!=")
INCREMENTS = ("+=", "-=", "*=", "/=")
QUEUE = ("queue", "push_back", "pop_front", "deque", "enqueue", "dequeue")
VISITED = ("visited", "seen", "marked")
MEMO = ("memo", "dp", "cache", "table")
ALLOCATING = ("vec", "new", "alloc", "create", "clone", "collect")
RANK = {"Constant": 0.0, "Logarithmic": 1.0, "Linear": 2.0, "Linearithmic": 3.0, "Quadratic": 4.0, "Cubic": 5.0, "Exponential": 7.0, "Factorial": 8.0}


def _has(name: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [name.contains(w) for w in words])


def rank(kind: str, power: str) -> Column:
    """Total order of complexity classes; a polynomial of power k from 4 on stands between cubic and exponential."""
    known = reduce(lambda e, kv: e.when(F.col(kind) == kv[0], F.lit(kv[1])), RANK.items(), F.when(F.lit(False), F.lit(0.0)))
    return known.otherwise(6.0 - 1.0 / F.col(power))


def _below(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, function_id, function_name and each node below, with what its direct children tell."""
    def key(column: str) -> Column:
        return F.struct("graph_id", F.col(column).alias("n"))

    down = edges.filter("kind = 'AstChild'")
    functions = nodes.filter("tag = 'Function'").select("graph_id", F.col("node_id").alias("function_id"), F.col("name").alias("function_name"))
    seeds = functions.select(key("function_id").alias("seed")).withColumn("node", F.col("seed"))
    reached = bfs(down.select(key("source").alias("src"), key("target").alias("dst")), seeds).filter("depth > 0")
    reached = reached.select("seed.graph_id", F.col("seed.n").alias("function_id"), F.col("node.n").alias("node_id"))
    child = nodes.select("graph_id", F.col("node_id").alias("target"), F.col("tag").alias("c_tag"), F.col("name").alias("c_name"), "literal_kind", "lit_int")
    number = F.when(F.col("literal_kind") == "Integer", F.col("lit_int"))
    named = F.when(F.col("c_tag").isin("Identifier", "MemberAccess"), F.col("c_name"))
    kids = down.join(child, ["graph_id", "target"]).groupBy("graph_id", F.col("source").alias("node_id")).agg(
        F.max(F.coalesce(number == 1, F.lit(False))).alias("kid_1"), F.max(F.coalesce(number == 2, F.lit(False))).alias("kid_2"), F.collect_set(named).alias("kid_names"),
        F.max(F.coalesce(_has(F.lower(named), ALLOCATING), F.lit(False))).alias("kid_allocates"),
    )
    own = nodes.select("graph_id", "node_id", "tag", "name", "operator", F.col("literal_kind").alias("own_literal"), "unknown_kind")
    return reached.join(own, ["graph_id", "node_id"]).join(functions, ["graph_id", "function_id"]).join(kids, ["graph_id", "node_id"], "left").na.fill(False, ["kid_1", "kid_2", "kid_allocates"])


def _do_while() -> Column:
    kind = F.coalesce("unknown_kind", F.lit(""))
    return (F.col("tag") == "Unknown") & (kind.contains("do_while") | kind.contains("do_statement"))


def _upward(nodes: DataFrame, below: DataFrame) -> DataFrame:
    """For loops, returns and calls: enclosing loops, whether guarded, and depth of the nearest return and operation."""
    up = nodes.filter("parent IS NOT NULL").select(F.struct("graph_id", F.col("node_id").alias("n")).alias("src"), F.struct("graph_id", F.col("parent").cast("bigint").alias("n")).alias("dst"))
    seeds = below.filter(F.col("tag").isin(*LOOPS, "Return", "Call") | _do_while()).select(F.struct("graph_id", F.col("node_id").alias("n")).alias("seed")).distinct().withColumn("node", F.col("seed"))
    over = bfs(up, seeds).filter("depth > 0").select("seed.graph_id", F.col("seed.n").alias("node_id"), F.col("node.n").alias("above"), "depth")
    tags = nodes.select("graph_id", F.col("node_id").alias("above"), F.col("tag").alias("a_tag"))
    never = F.lit(1 << 40)
    return over.join(tags, ["graph_id", "above"]).groupBy("graph_id", "node_id").agg(
        F.count_if(F.col("a_tag").isin(*LOOPS)).alias("loops_above"), F.max(F.col("a_tag").isin(*GUARDS)).alias("guarded"),
        F.coalesce(F.min(F.when(F.col("a_tag") == "Return", F.col("depth"))), never).alias("to_return"),
        F.coalesce(F.min(F.when(F.col("a_tag").isin("BinaryOp", "UnaryOp", "Call"), F.col("depth"))), never).alias("to_operation"),
    )


def loops(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, function_id, node_id, kind, depth, counted of each loop below a function."""
    below = cut(_below(nodes, edges))
    return _loops(nodes, edges, below, cut(_upward(nodes, below)))


def _loops(nodes: DataFrame, edges: DataFrame, below: DataFrame, up: DataFrame) -> DataFrame:
    kind = F.when(F.col("tag") == "For", "For").when(F.col("tag") == "While", "While").when(F.col("tag") == "Loop", "Infinite").when(_do_while(), "DoWhile")
    found = below.withColumn("kind", kind).filter("kind IS NOT NULL").select("graph_id", "function_id", "node_id", "kind")
    found = found.join(up.select("graph_id", "node_id", "loops_above"), ["graph_id", "node_id"], "left").withColumn("depth", F.coalesce("loops_above", F.lit(0)) + 1)
    step = edges.filter("kind = 'AstChild'").select(F.struct("graph_id", F.col("source").alias("n")).alias("src"), F.struct("graph_id", F.col("target").alias("n")).alias("dst"))
    seeds = found.filter("kind IN ('While', 'DoWhile')").select(F.struct("graph_id", F.col("node_id").alias("n")).alias("seed")).distinct().withColumn("node", F.col("seed"))
    inside = bfs(step, seeds).filter("depth > 0").select("seed.graph_id", F.col("seed.n").alias("loop"), F.col("node.n").alias("node_id")).join(nodes.select("graph_id", "node_id", "tag", "operator"), ["graph_id", "node_id"])
    compares = (F.col("tag") == "BinaryOp") & F.col("operator").isin(*COMPARISONS)
    steps = ((F.col("tag") == "UnaryOp") & F.col("operator").isin("++", "--")) | ((F.col("tag") == "Assignment") & F.col("operator").isin(*INCREMENTS))
    cues = inside.groupBy("graph_id", F.col("loop").alias("node_id")).agg((F.max(F.coalesce(compares, F.lit(False))) & F.max(F.coalesce(steps, F.lit(False)))).alias("both"))
    counted = F.when(F.col("kind") == "For", F.lit(True)).when(F.col("kind") == "Infinite", F.lit(False)).otherwise(F.coalesce("both", F.lit(False)))
    return found.join(cues, ["graph_id", "node_id"], "left").select("graph_id", "function_id", "node_id", "kind", "depth", counted.alias("counted"))


def estimates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A row for each function: its cues, recursion (null, Direct, Tail), time and space class with confidence.

    A class Polynomial has its power in time_power; all other classes have 0 there.
    """
    nodes, edges = cut(nodes), cut(edges)
    below = cut(_below(nodes, edges))
    up = cut(_upward(nodes, below))
    low = F.lower(F.coalesce("name", F.lit("")))
    ident, binary = F.col("tag") == "Identifier", F.col("tag") == "BinaryOp"
    named = F.col("tag").isin("Identifier", "MemberAccess")
    halves = binary & F.col("operator").isin("/", ">>")
    self_call = (F.col("tag") == "Call") & F.coalesce(F.array_contains("kid_names", F.col("function_name")), F.lit(False))
    rows = cut(below.withColumn("self_call", self_call).join(up, ["graph_id", "node_id"], "left"))

    def any_(test: Column) -> Column:
        return F.max(F.coalesce(test, F.lit(False)))

    cues = rows.groupBy("graph_id", "function_id").agg(
        any_(binary & F.col("operator").isin(*COMPARISONS)).alias("compares"),
        (any_(named & low.contains("swap")) | (F.count_if(F.col("tag") == "Assignment") >= 3)).alias("swaps"),
        any_(binary & (F.col("operator") == "+") & F.col("kid_1")).alias("adjacent"),
        any_(F.col("tag") == "IndexAccess").alias("indexes"),
        any_((F.col("tag") == "Return") & (F.col("loops_above") > 0)).alias("early_return"),
        any_((halves & (F.col("kid_1") | F.col("kid_2"))) | (ident & low.isin("mid", "middle"))).alias("midpoint"),
        any_((halves & F.col("kid_2")) | (ident & (low.isin("mid", "middle", "pivot") | low.contains("half")))).alias("halving"),
        any_(named & _has(low, QUEUE)).alias("queue"),
        any_(named & (low.contains("stack") | low.isin("push", "pop"))).alias("stack"),
        any_(ident & _has(low, VISITED)).alias("visited"),
        any_(ident & (_has(low, MEMO) | (low == "f"))).alias("memo"),
        any_((F.col("own_literal") == "Array") | ((F.col("tag") == "Call") & F.col("kid_allocates"))).alias("allocates"),
        F.count_if("self_call").alias("n_self"),
        any_(F.col("self_call") & (F.col("to_return") < F.col("to_operation"))).alias("tail"),
    )
    # a guarded return without a recursive call below it is a base case
    returns = rows.filter("tag = 'Return' AND guarded").select("graph_id", "function_id", F.col("node_id").alias("ret"))
    step = edges.filter("kind = 'AstChild'").select(F.struct("graph_id", F.col("source").alias("n")).alias("src"), F.struct("graph_id", F.col("target").alias("n")).alias("dst"))
    inner = bfs(step, returns.select(F.struct("graph_id", F.col("ret").alias("n")).alias("seed")).distinct().withColumn("node", F.col("seed")))
    calling = inner.select("seed.graph_id", F.col("seed.n").alias("ret"), F.col("node.n").alias("node_id")).join(rows.filter("self_call").select("graph_id", "function_id", "node_id"), ["graph_id", "node_id"]).select("graph_id", "function_id", "ret")
    bases = returns.join(calling, ["graph_id", "function_id", "ret"], "left_anti").groupBy("graph_id", "function_id").agg(F.count(F.lit(1)).alias("n_base"))
    in_loops = _loops(nodes, edges, below, up).groupBy("graph_id", "function_id").agg(F.count(F.lit(1)).alias("n_loops"), F.max("depth").alias("loop_depth"), F.min("counted").alias("counted"), F.max(F.col("kind") == "While").alias("has_while"))
    all_ = nodes.filter("tag = 'Function'").select("graph_id", F.col("node_id").alias("function_id"), F.col("name").alias("function_name"))
    for part in (cues, bases, in_loops):
        all_ = all_.join(part, ["graph_id", "function_id"], "left")
    all_ = all_.na.fill(0).na.fill(False)
    c = F.col

    def estimate(kind, confidence: float | Column, power: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), (power if power is not None else F.lit(0)).cast("bigint").alias("power"), (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence"))

    d, n = c("loop_depth"), c("n_self")
    by_loops = F.when(c("n_loops") > 0, F.when(d == 1, estimate("Linear", F.when(c("counted"), 0.8).otherwise(0.6))).when(d == 2, estimate("Quadratic", F.when(c("counted"), 0.8).otherwise(0.5))).when(d == 3, estimate("Cubic", 0.7)).otherwise(estimate("Polynomial", 0.6, d)))
    halved = F.when(n == 1, estimate("Logarithmic", 0.8)).when(n == 2, estimate("Linearithmic", 0.7)).otherwise(estimate("Polynomial", 0.5, n))
    plain = F.when(n == 1, estimate("Linear", F.when(c("n_base") > 0, 0.7).otherwise(0.4))).otherwise(estimate("Exponential", F.when(n == 2, 0.7).otherwise(0.6)))
    by_recursion = F.when(n > 0, F.when(c("tail"), estimate("Linear", 0.8)).when(c("halving"), halved).otherwise(plain))
    all_ = all_.withColumns({"_l": by_loops, "_r": by_recursion})
    all_ = all_.withColumns({"_lr": rank("_l.kind", "_l.power"), "_rr": rank("_r.kind", "_r.power")})
    time = F.when(c("_l").isNull() & c("_r").isNull(), estimate("Constant", 0.9)).when(c("_r").isNull(), c("_l")).when(c("_l").isNull(), c("_r")).when(c("_rr") < c("_lr"), c("_l")).otherwise(c("_r"))
    space = F.when(n > 0, estimate(F.when(c("tail"), "Constant").otherwise("Linear"), 0.6)).when(c("allocates"), estimate("Linear", 0.5)).otherwise(estimate("Constant", 0.7))
    all_ = all_.withColumns({"_t": time, "_s": space, "recursion": F.when(n > 0, F.when(c("tail"), "Tail").otherwise("Direct"))})
    return all_.withColumns({"time": c("_t.kind"), "time_power": c("_t.power"), "time_confidence": c("_t.confidence"), "space": c("_s.kind"), "space_confidence": c("_s.confidence")}).drop("_l", "_r", "_lr", "_rr", "_t", "_s")


def families(est: DataFrame, least: float = LEAST) -> DataFrame:
    """graph_id, function_id, family, name, confidence of what the cues and the time class suggest."""
    c = F.col

    def guess(family: str, *cases: tuple[Column, str | None, float]) -> Column:
        expr = None
        for test, name, confidence in cases:
            value = F.struct(F.lit(family).alias("family"), F.lit(name).cast("string").alias("name"), F.lit(confidence).alias("confidence"))
            expr = F.when(test, value) if expr is None else expr.when(test, value)
        return expr

    sorts, finds = (c("n_loops") > 0) & c("compares"), c("compares")
    square, log, line = c("time") == "Quadratic", c("time") == "Logarithmic", c("time") == "Linear"
    recursive = c("n_self") > 0
    divides = recursive & c("time").isin("Logarithmic", "Linearithmic")
    rows = F.array(
        guess("Sorting", (sorts & square & c("swaps") & c("adjacent"), "Bubble Sort", 0.7), (sorts & square & c("swaps"), "Selection Sort", 0.6), (sorts & square & c("indexes"), "Insertion Sort", 0.6), (sorts & square, None, 0.5), (sorts & (c("time") == "Linearithmic"), None, 0.6), (sorts & line, None, 0.4)),
        guess("Searching", (finds & log & (recursive | c("midpoint")), "Binary Search", 0.8), (finds & log, None, 0.6), (finds & line & (c("n_loops") == 1) & c("early_return"), "Linear Search", 0.7), (finds & line, None, 0.5)),
        guess("GraphTraversal", (c("visited") & c("queue"), "BFS", 0.7), (c("visited") & (c("stack") | c("has_while")), "DFS", 0.6)),
        guess("DynamicProgramming", (c("memo") & (c("loop_depth") >= 2), None, 0.7), (c("memo"), None, 0.5)),
        guess("DivideAndConquer", (divides & (c("n_self") == 1), None, 0.6), (divides & (c("n_self") == 2), None, 0.7), (divides, None, 0.5)),
    )
    found = est.select("graph_id", "function_id", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("f"))
    return found.select("graph_id", "function_id", "f.*").filter(c("confidence") >= least)
