"""Control flow, data flow and program dependence, extracted graph by graph.

A graph is one source file, so it fits a task; graphs are dealt out by id. All walks are generators run on an explicit
stack, so nesting depth is no limit, and a node that is met again on its own path is not entered twice.

Positions of children carry meaning: a function's body is its last child; If has condition, then, else; While has
condition and body; For ends with its body, Loop begins with it; a MatchArm's and a Catch's body come last.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Generator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import kinds
from ..plans.fixpoint import bfs
from ..plans.storage import cut

NEW_EDGE = "graph_id bigint, source bigint, target bigint, family string, kind string, subkind string"
ENDS_BLOCK = ("Return", "Break", "Continue", "Throw")
REGIONS = ("If", "Else", "While", "For", "Loop", "Match", "MatchArm", "Try", "Catch", "Finally")
LOOPS = ("While", "For", "Loop")
Walk = Generator[int, list[int], list[int]]


class Tree:
    def __init__(self, nodes: pd.DataFrame, edges: pd.DataFrame):
        def column(name: str) -> dict:
            return {} if name not in nodes else {i: v for i, v in zip(nodes["node_id"], nodes[name], strict=True) if not pd.isna(v)}

        self.tag = {int(i): t for i, t in zip(nodes["node_id"], nodes["tag"], strict=True)}
        self.name, self.operator, self.parent = column("name"), column("operator"), column("parent")
        self.call_target = {i: int(t) for i, t in column("call_target").items()}
        self.children: dict[int, list[int]] = defaultdict(list)
        down = edges[edges["kind"] == "AstChild"].sort_values("edge_id")
        for a, b in zip(down["source"], down["target"], strict=True):
            self.children[int(a)].append(int(b))
        self.callers: dict[int, list[int]] = defaultdict(list)
        calls = edges[edges["kind"].isin(kinds.CALL)].sort_values("edge_id")
        for a, b in zip(calls["source"], calls["target"], strict=True):
            self.callers[int(b)].append(int(a))

    def below(self, node: int) -> list[int]:
        """Descendants, each once, in pre-order."""
        seen, todo, out = {node}, list(reversed(self.children.get(node, ()))), []
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                out.append(n)
                todo.extend(reversed(self.children.get(n, ())))
        return out

    def functions(self) -> list[int]:
        return sorted(n for n, t in self.tag.items() if t == "Function")


class ControlFlow:
    """Edges (source, target, subkind) of all functions of a tree, and the exits of each."""

    def __init__(self, tree: Tree, exceptions: bool = True, calls: bool = True):
        self.tree, self.exceptions, self.calls = tree, exceptions, calls
        self.edges: dict[tuple[int, int, str], None] = {}
        self.exits: dict[int, list[int]] = {}
        self.entries: list[int] = []
        for f in tree.functions():
            self.loops: list[tuple[int, int, list[int]]] = []  # header, where continue goes, breaks
            self.handlers: list[list[int]] = []
            self.entries.append(f)
            if kids := tree.children.get(f):
                self._to(f, kids[-1])
                self.exits[f] = self._run(kids[-1])

    def _to(self, source: int, target: int, subkind: str = "Sequential") -> None:
        self.edges[source, target, subkind] = None

    def _all(self, sources: list[int], target: int, subkind: str = "Sequential") -> None:
        for s in sources:
            self._to(s, target, subkind)

    def _run(self, node: int) -> list[int]:
        """Runs the walk of `node` and of all it asks for; what a walk returns are its exits."""
        stack: list[tuple[int, Walk]] = [(node, self._walk(node))]
        path, answer = {node}, None
        while True:
            n, walk = stack[-1]
            try:
                wanted = walk.send(answer)
            except StopIteration as done:
                stack.pop()
                path.discard(n)
                answer = done.value
                if not stack:
                    return answer
                continue
            answer = None
            if wanted in path:
                answer = [wanted]
            else:
                path.add(wanted)
                stack.append((wanted, self._walk(wanted)))

    def _walk(self, n: int) -> Walk:
        kids, tag = self.tree.children.get(n, []), self.tree.tag.get(n)
        if tag in LOOPS:
            return self._loop(n, tag, kids)
        if tag == "Call" and not self.calls or tag == "Try" and not self.exceptions:
            return self._sequence(n, kids)
        own = {"Block": self._block, "If": self._branch, "Match": self._choice, "Return": self._leave, "Break": self._jump, "Continue": self._jump, "Try": self._guarded, "Throw": self._raise, "Call": self._call}
        return own.get(tag, self._sequence)(n, kids)

    def _sequence(self, n: int, kids: list[int]) -> Walk:
        """Anything else: all children are visited, the first is linked, the last one's exits count."""
        exits = [n]
        if kids:
            self._to(n, kids[0])
        for k in kids:
            exits = yield k
        return exits

    def _block(self, n: int, kids: list[int]) -> Walk:
        open_, closed, ended = [n], [], False
        for k in kids:
            self._all(open_, k)
            exits = yield k
            if self.tree.tag.get(k) in ENDS_BLOCK:
                closed += exits
                ended = True
                open_ = []
            else:
                open_ = exits
        if ended:
            # statements after a jump are linked among themselves, but lead nowhere
            return closed or [n]
        return closed + open_ or [n]

    def _branch(self, n: int, kids: list[int]) -> Walk:
        if not kids:
            return [n]
        condition = kids[0]
        self._to(n, condition)
        if len(kids) == 1:
            return [condition]
        self._to(condition, kids[1], "ConditionalTrue")
        exits = list((yield kids[1]))
        if len(kids) == 2:
            return [*exits, condition]
        other = kids[2]
        if self.tree.tag.get(other) == "Else":
            other = next(iter(self.tree.children.get(other, ())), other)
        self._to(condition, other, "ConditionalFalse")
        exits += yield other
        return exits or [n]

    def _loop(self, n: int, tag: str, kids: list[int]) -> Walk:
        if len(kids) < (2 if tag == "While" else 1):
            return [n]
        if tag == "While":
            head, body = kids[0], kids[1]
            self._to(n, head)
        else:
            head, body = n, kids[-1] if tag == "For" else kids[0]
        self._to(head, body, "Sequential" if tag == "Loop" else "ConditionalTrue")
        self.loops.append((n, head, []))
        self._all((yield body), head, "LoopBack")
        breaks = self.loops.pop()[2]
        return breaks if tag == "Loop" else [head, *breaks]

    def _jump(self, n: int, kids: list[int]) -> Walk:
        if self.loops:
            header, again, breaks = self.loops[-1]
            if self.tree.tag[n] == "Break":
                breaks.append(n)
                self._to(n, header, "Break")
            else:
                self._to(n, again, "Continue")
        return []
        yield

    def _leave(self, n: int, kids: list[int]) -> Walk:
        if kids:
            self._to(n, kids[0])
            yield kids[0]
        return [n]

    def _choice(self, n: int, kids: list[int]) -> Walk:
        source, arms, exits = n, kids, []
        if len(kids) > 1 and self.tree.tag.get(kids[0]) != "MatchArm":
            source, arms = kids[0], kids[1:]
            self._to(n, source)
        for arm in arms:
            if self.tree.tag.get(arm) == "MatchArm":
                self._to(source, arm, "Case")
                body = self.tree.children.get(arm)
                if body:
                    self._to(arm, body[-1])
                    exits += yield body[-1]
                else:
                    exits.append(arm)
        return exits or [n]

    def _guarded(self, n: int, kids: list[int]) -> Walk:
        def of(tag: str) -> list[int]:
            return [k for k in kids if self.tree.tag.get(k) == tag]

        catches, last, exits = of("Catch"), of("Finally")[-1:], []
        bodies = [(n, b) for b in of("Block")[:1]] + [(c, self.tree.children[c][-1]) for c in catches if self.tree.children.get(c)]
        for owner, body in bodies:
            self._to(owner, body)
            if owner == n:
                self.handlers.append(catches)
            ends = yield body
            if owner == n:
                self.handlers.pop()
            if last:
                self._all(ends, last[0])
            else:
                exits += ends
        if last:
            exits += yield last[0]
        return exits or [n]

    def _raise(self, n: int, kids: list[int]) -> Walk:
        if not self.exceptions:
            return [n]
        if kids:
            self._to(n, kids[0])
            yield kids[0]
        for catch in self.handlers[-1] if self.handlers else ():
            self._to(n, catch, "Throw")
        return []

    def _call(self, n: int, kids: list[int]) -> Walk:
        for k in kids:
            self._to(n, k)
            yield k
        if n in self.tree.call_target:
            self._to(n, self.tree.call_target[n], "Call")
        return [n]


def _definitions_reaching(tree: Tree, function: int) -> list[tuple[int, int]]:
    """(definition, use): a sweep in source order. Straight-line definitions replace what was known of a name, those in
    conditional regions add to it; loop bodies are swept twice. Children come before what their parent defines."""
    known: dict[str, list[int]] = defaultdict(list)
    pairs: list[tuple[int, int]] = []
    path = {function}

    def bind(name: str | None, n: int, weak: bool) -> None:
        if name:
            if not weak:
                known[name].clear()
            if n not in known[name]:
                known[name].append(n)

    def ident(n: int | None) -> str | None:
        return tree.name.get(n) if tree.tag.get(n) == "Identifier" else None

    todo: list[tuple] = [("visit", c, False) for c in reversed(tree.children.get(function, []))]
    while todo:
        what, n, weak, *rest = todo.pop()
        if what == "bind":
            bind(rest[0], n, weak)
            continue
        if what == "leave":
            path.discard(n)
            continue
        tag = tree.tag.get(n)
        if tag is None or n in path:
            continue
        kids = tree.children.get(n, [])
        if tag == "Identifier":
            pairs += [(d, n) for d in known.get(tree.name.get(n), ())]
            continue
        path.add(n)
        todo.append(("leave", n, weak))
        if tag in ("Variable", "Parameter"):
            name = tree.name.get(n)
            own = next((k for k in kids if name and ident(k) == name), None)
            todo.append(("bind", n, weak, name))
            visits = [k for k in kids if k != own]
        elif tag == "Assignment":
            target = ident(kids[0]) if kids else None
            todo.append(("bind", n, weak, target))
            plain = target is not None and tree.operator.get(n) == "="
            visits = [k for k in kids if not (plain and k == kids[0])]
        else:
            weak = weak or tag in REGIONS
            visits = kids * 2 if tag in LOOPS else kids
        todo += [("visit", k, weak) for k in reversed(visits)]
    return pairs


def data_flow(tree: Tree) -> dict[tuple[int, int, str], None]:
    """Edges (source, target, subkind) of all functions of a tree."""
    edges: dict[tuple[int, int, str], None] = {}
    for f in tree.functions():
        edges |= {(d, u, "DefUse"): None for d, u in _definitions_reaching(tree, f) if d != u}
        below = tree.below(f)
        parameters = [k for k in tree.children.get(f, []) if tree.tag.get(k) == "Parameter"]
        uses = defaultdict(list)
        for n in below:
            up = tree.parent.get(n)
            if tree.tag[n] == "Identifier" and not (tree.tag.get(up) == "Assignment" and tree.children.get(up, [None])[0] == n):
                uses[tree.name.get(n)].append(n)
        for caller in tree.callers.get(f, ()):
            edges |= {(a, p, "Parameter"): None for a, p in zip(tree.children.get(caller, []), parameters, strict=False)}
        for p in parameters:
            edges |= {(p, u, "DefUse"): None for u in uses.get(tree.name.get(p), ()) if tree.name.get(p) is not None}
        for n in below:
            kids = tree.children.get(n, [])
            if tree.tag[n] == "Return" and kids:
                edges |= {(kids[0], c, "ReturnValue"): None for c in tree.callers.get(f, ())}
            elif tree.tag[n] == "MemberAccess" and kids:
                edges[kids[0], n, "FieldRead"] = None
            elif tree.tag[n] == "IndexAccess" and len(kids) > 1:
                edges[kids[0], n, "IndexRead"] = None
                edges[kids[1], n, "DataDependency"] = None
    return edges


def control_dependence(tree: Tree, flow: ControlFlow, function: int) -> set[tuple[int, int]]:
    """(branch, dependent): what post-dominates a successor of the branch without post-dominating the branch itself.

    Sets of post-dominators are bit masks that shrink to a fixpoint. Nodes from which no exit can be reached count as
    leading to it; a function without any exit has no dependences.
    """
    after: dict[int, list[int]] = defaultdict(list)
    for a, b, subkind in flow.edges:
        if subkind != "Call":
            after[a].append(b)
    order, seen, todo = [], {function}, [function]
    while todo:
        n = todo.pop()
        order.append(n)
        for m in after.get(n, ()):
            if m not in seen:
                seen.add(m)
                todo.append(m)
    if len(order) < 2:
        return set()
    exit_ = -1
    ends = {e for x in flow.exits.values() for e in x}
    follow = {n: set(after.get(n, ())) for n in order}
    for n in order:
        if not follow[n] or tree.tag.get(n) in ("Return", "Throw") or n in ends:
            follow[n].add(exit_)
    if not any(exit_ in s for s in follow.values()):
        return set()
    before: dict[int, list[int]] = defaultdict(list)
    for n, s in follow.items():
        for m in s:
            before[m].append(n)
    leads, todo = {exit_}, [exit_]
    while todo:
        for n in before.get(todo.pop(), ()):
            if n not in leads:
                leads.add(n)
                todo.append(n)
    for n in order:
        if n not in leads:
            follow[n].add(exit_)
    bit = {n: 1 << k for k, n in enumerate([exit_, *order])}
    full = (1 << len(bit)) - 1
    post = dict.fromkeys(order, full) | {exit_: bit[exit_]}
    changed = True
    while changed:
        changed = False
        for n in reversed(order):
            common = full
            for m in follow[n]:
                common &= post[m]
            if (mask := common | bit[n]) != post[n]:
                post[n], changed = mask, True
    found = set()
    for n in order:
        if len(follow[n]) > 1:
            strict = post[n] & ~bit[n]
            reached = 0
            for m in follow[n]:
                reached |= post[m]
            found |= {(n, m) for m in order if reached & ~strict & bit[m]}
    return found


def _by_graph(nodes: DataFrame, edges: DataFrame):
    """Both sides by graph; the edges' key is named anew, as nodes and edges may come from one frame."""
    return nodes.groupBy("graph_id").cogroup(edges.withColumnRenamed("graph_id", "of_graph").groupBy("of_graph"))


def extract(nodes: DataFrame, edges: DataFrame, exceptions: bool = True, calls: bool = True) -> DataFrame:
    """New edges (NEW_EDGE): control flow, data flow, control and data dependence of all functions.

    nodes: graph_id, node_id, tag, name, and operator, parent, call_target where known; edges: graph_id, edge_id,
    source, target, kind.
    """

    def run(key: tuple, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(n, e)
        flow, data = ControlFlow(tree, exceptions, calls), data_flow(tree)
        rows = [(a, b, "cfg", "ControlFlow", s) for a, b, s in flow.edges] + [(a, b, "dfg", "DataFlow", s) for a, b, s in data]
        dependent: set[tuple] = set()
        for f in tree.functions():
            inside = {f, *tree.below(f)}
            dependent |= {(a, b, "pdg", "ControlDependence", None) for a, b in control_dependence(tree, flow, f)}
            dependent |= {(a, b, "pdg", "DataDependence", None) for a, b, s in data if s == "DefUse" and a in inside and b in inside}
        out = pd.DataFrame(rows + sorted(dependent, key=str), columns=["source", "target", "family", "kind", "subkind"])
        out.insert(0, "graph_id", key[0])
        return out

    return _by_graph(nodes, edges).applyInPandas(run, NEW_EDGE)


def marks(nodes: DataFrame, edges: DataFrame, exceptions: bool = True, calls: bool = True) -> DataFrame:
    """graph_id, function_id, node_id, mark: each function as its own entry, and the exits of its control flow, once."""

    def run(key: tuple, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        flow = ControlFlow(Tree(n, e), exceptions, calls)
        rows = [(key[0], f, f, "entry") for f in flow.entries] + [(key[0], f, x, "exit") for f, own in flow.exits.items() for x in dict.fromkeys(own)]
        return pd.DataFrame(rows, columns=["graph_id", "function_id", "node_id", "mark"])

    return _by_graph(nodes, edges).applyInPandas(run, "graph_id bigint, function_id bigint, node_id bigint, mark string")


BRANCHES = ("If", "While", "For", "Loop", "Match", "Return", "Break", "Continue")


def basic_blocks(nodes: DataFrame, cfg: DataFrame) -> DataFrame:
    """graph_id, leader, node_id, position: the blocks of all functions, over control-flow edges.

    Leaders are functions, targets of conditional and loop edges, and successors of branching nodes. A block follows its
    leader along lone sequential edges to nodes that lead none; rounds of joins, one for each further node.
    """
    key = ["graph_id", "node_id"]
    functions = nodes.filter("tag = 'Function'").select(*key)
    targets = cfg.filter(kinds.is_conditional() | kinds.is_loop()).select("graph_id", F.col("target").alias("node_id"))
    branching = nodes.filter(F.col("tag").isin(*BRANCHES)).select("graph_id", F.col("node_id").alias("source"))
    after = cfg.join(branching, ["graph_id", "source"], "left_semi").select("graph_id", F.col("target").alias("node_id"))
    leaders = cut(functions.unionByName(targets).unionByName(after).distinct().join(nodes.select(*key), key, "left_semi"))
    lone = cfg.groupBy("graph_id", "source").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("target"), F.min("subkind").alias("subkind")).filter("n = 1 AND subkind = 'Sequential'")
    step = lone.join(leaders.select("graph_id", F.col("node_id").alias("target")), ["graph_id", "target"], "left_anti")
    step = step.select(F.struct("graph_id", F.col("source").alias("n")).alias("src"), F.struct("graph_id", F.col("target").alias("n")).alias("dst"))
    seeds = leaders.select(F.struct("graph_id", F.col("node_id").alias("n")).alias("seed")).withColumn("node", F.col("seed"))
    return bfs(step, seeds).select("seed.graph_id", F.col("seed.n").alias("leader"), F.col("node.n").alias("node_id"), F.col("depth").alias("position"))


def slices(dependences: DataFrame, criteria: DataFrame, backward: bool = False, most: int | None = None) -> DataFrame:
    """graph_id, criterion, node_id, depth: what each criterion (graph_id, node_id) reaches over dependence edges, itself
    included; of more than `most` nodes those of least depth, then id, stay."""
    a, b = ("target", "source") if backward else ("source", "target")
    step = dependences.select(F.struct("graph_id", F.col(a).alias("n")).alias("src"), F.struct("graph_id", F.col(b).alias("n")).alias("dst"))
    seeds = criteria.select(F.struct("graph_id", F.col("node_id").alias("n")).alias("seed")).withColumn("node", F.col("seed"))
    found = bfs(step, seeds).select("seed.graph_id", F.col("seed.n").alias("criterion"), F.col("node.n").alias("node_id"), "depth")
    if most is None:
        return found
    order = W.partitionBy("graph_id", "criterion").orderBy("depth", "node_id")
    return found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def chains(flow: DataFrame, nodes: DataFrame) -> DataFrame:
    """graph_id, name, definition, use of every DefUse edge; filter by definition or use for the one's uses or the other's
    definitions. The name is the use's."""
    named = nodes.select("graph_id", F.col("node_id").alias("use"), "name")
    pairs = flow.filter("subkind = 'DefUse'").select("graph_id", F.col("source").alias("definition"), F.col("target").alias("use")).distinct()
    return pairs.join(named, ["graph_id", "use"]).select("graph_id", "name", "definition", "use")
