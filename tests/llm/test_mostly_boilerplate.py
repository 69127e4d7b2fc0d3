"""Documents that are mostly boilerplate lose it; groups of copies count as one document."""

import random

from sylvagraph.llm import line_templates
from test_dedup import edited

DOC = "doc_id bigint, text string"


def test_mostly_boilerplate(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    prose = lambda n: " ".join(word() for _ in range(n))
    common = ["All rights to this text are reserved worldwide", "Please send corrections to the address given below"]
    rare = ["Printed on paper that comes from managed woods", "No part of it may be sold without consent"]
    rows, expected = [], {}
    for k in range(12):  # most of the words recur, here and in longer texts
        rows.append((k, "\n".join([common[0], prose(5), common[1]])))
        expected[k] = [0, 2]
        rows.append((100 + k, "\n".join([common[0], prose(30), common[1], prose(30)])))
        expected[100 + k] = [0, 2]
        rows.append((200 + k, "\n".join([rare[0], prose(8), rare[1]])))  # lines that only such texts have
        expected[200 + k] = [0, 2]
    base = [[word() for _ in range(12)] for _ in range(12)]
    for k in range(30):  # near copies: a word is edited in one line
        lines = list(base)
        lines[k % 12] = edited(rnd, lines[k % 12], 1)
        rows.append((300 + k, "\n".join(" ".join(x) for x in lines)))
        expected[300 + k] = []
    rows += [(400 + k, "\n".join([rows[0][1], "a b c"])) for k in range(2)]
    expected |= {400: [0, 2], 401: [0, 2]}
    got = line_templates.drop_templates(spark.createDataFrame(rows, DOC)).collect()
    assert {r.doc_id: r._dropped for r in got} == expected
    texts = dict(rows)
    for r in got:
        assert r.text == "\n".join(x for k, x in enumerate(texts[r.doc_id].split("\n")) if k not in r._dropped)
