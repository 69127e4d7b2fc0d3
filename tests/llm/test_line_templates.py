"""Line templates against a brute force over whole small corpora."""

import random
from collections import Counter, defaultdict

import pytest

from sylvagraph.llm import line_templates

DOC = "doc_id bigint, text string, _row int, _id string, _line int, _numbers string, _own double, _dropped_ int"


def brute(rows, least):
    """The numbers of the dropped lines, for texts that aren't near copies of each other."""
    def tokens(line):
        return ["<*>" if any(c in "0123456789" for c in w) else w for w in line.split()]

    lines = [[tokens(x) for x in (t or "").split("\n")] if t is not None else [] for _, t in rows]
    docs_of = defaultdict(set)
    for (d, _), own in zip(rows, lines):
        for w in own:
            if w:
                docs_of[tuple(w)].add(d)
    leaf = lambda w: (len(w), w[:3])
    weight = Counter()
    for w, ds in docs_of.items():
        for p, x in enumerate(w):
            weight[leaf(w), p, x] += len(ds)
    members, docs_in = defaultdict(list), defaultdict(set)
    for w, ds in docs_of.items():
        constant = frozenset((p, x) for p, x in enumerate(w) if weight[leaf(w), p, x] >= least)
        fixed = sum(x != "<*>" for _, x in constant)
        if fixed >= 0.7 * len(w) or len(ds) >= least and fixed:
            members[leaf(w), constant].append(w)
            docs_in[leaf(w), constant] |= ds
    template = {w: t for t, ws in members.items() if len(docs_in[t]) >= least for w in ws}
    units, mostly = defaultdict(set), []
    for (d, t), own in zip(rows, lines):
        words = sum(map(len, own))
        mostly.append(sum(len(w) for w in own if tuple(w) in template) > 0.5 * words)
        for w in own:
            if tuple(w) in template:
                units[template[tuple(w)]].add(("text", t) if mostly[-1] else ("id", d))
    return [[k for k, w in enumerate(own) if tuple(w) in template and (not m or len(units[template[tuple(w)]]) >= least)] for own, m in zip(lines, mostly)]


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(5))
    names = [word() for _ in range(40)]
    kinds = [
        lambda: f"Posted by user {rnd.choice(names)} in the general section today",
        lambda: f"Posted by user {rnd.choice(names)} from a phone last night",  # shares its leaf with the one above
        lambda: f"Copyright {rnd.randrange(1900, 2030)} by the authors of this",
        lambda: "All rights reserved",
        lambda: "Share",
        lambda: f"{rnd.randrange(99)}",
        lambda: f"The {word()} {word()} of {word()} and {word()}",
    ]
    rows = []
    for k in range(70):
        lines = []
        for _ in range(rnd.randrange(6)):
            lines.append(rnd.choice(kinds)() if rnd.random() < 0.5 else " ".join(word() for _ in range(rnd.randrange(1, 15))))
        rows.append((k // 2 if k % 9 == 0 else 100 + k, "\n".join(lines)))
    rows += [(500, None), (501, ""), (502, "\n \n"), (None, "Share\nand something of its own"), (None, "Share\nand something else of its own"), rows[1], rows[1]]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, 0, "", 0, "", 0.0, 0) for d, t in rows], DOC)
    got = line_templates.drop_templates(df, min_docs=6)
    assert got.columns == [*df.columns, "_dropped"]
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "", x[2])
    expected = [(d, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone), gone) for (d, t), gone in zip(rows, brute(rows, 6))]
    assert sorted(((r.doc_id, r.text, r._dropped) for r in got.collect()), key=key) == sorted(expected, key=key)
    assert line_templates.drop_templates(df.limit(0)).count() == 0


def test_a_very_long_text(spark):
    text = "\n".join(f"line {k} of " + "a long text " * 20 for k in range(4000))
    rows = [(k, text if k == 0 else f"line {k} of " + "a long text " * 20) for k in range(12)]
    got = {r.doc_id: r for r in line_templates.drop_templates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(text) > 900_000 and len(got[0]._dropped) in (0, 4000)
