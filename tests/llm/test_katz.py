"""Katz scores against a brute force that shares no code with them."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from sylvagraph.llm import katz, queries

DOC = "doc_id bigint, text string, part int, words string, bucket double"


def good_turing(counts):
    """Discounts of counts 1..5; half a count where there is too little to go by."""
    n = Counter(counts.values())
    half = {r: (r - 0.5) / r for r in range(1, 6)}
    if any(n[r] == 0 for r in range(1, 7)) or 6 * n[6] >= n[1]:
        return half
    a = 6 * n[6] / n[1]
    d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, 6)}
    return d if all(0 < x < 1 for x in d.values()) else half


def brute(rows, order):
    docs = [(i, (t or "").encode().lower().split() + ["end"], i is not None and zlib.crc32(str(i).encode()) % 7 == 2) for i, t in rows]
    grams = lambda w, k, j: tuple((["begin", *w])[j + 2 - k : j + 2])
    count = {k: Counter() for k in range(1, order + 1)}
    for _, w, out in docs:
        if not out:
            for k in count:
                count[k].update(grams(w, k, j) for j in range(len(w)) if j + 2 - k >= 0)
    n, v = sum(count[1].values()), len(count[1])
    d = {k: good_turing(c) for k, c in count.items()}
    cut = lambda k, c: d[k].get(c, 1.0) * c
    freed = n - sum(cut(1, c) for c in count[1].values())
    one = {g: cut(1, c) / n * (1 if freed else n / (n + 1)) for g, c in count[1].items()}
    unknown = 1.0 if not n else freed / n if freed else 1 / (n + 1)
    after = defaultdict(list)
    for k in range(2, order + 1):
        for g in count[k]:
            after[g[:-1]].append(g)
    memo = {}

    def context(h):
        """total, share and backoff weight of a context."""
        if h not in memo:
            k = len(h) + 1
            total = sum(count[k][g] for g in after[h])
            kept = sum(cut(k, count[k][g]) for g in after[h])
            share = total / (total + 1) if total - kept < 1e-9 * total else 1.0
            memo[h] = total, share, (1 - share * kept / total) / (1 - sum(p(g[1:]) for g in after[h]))
        return memo[h]

    def p(g):
        if len(g) == 1:
            return one.get(g, unknown)
        h = g[:-1]
        if not after[h]:
            return p(g[1:])
        total, share, bow = context(h)
        return share * cut(len(g), count[len(g)][g]) / total if count[len(g)][g] else bow * p(g[1:])

    rnd = random.Random(3)
    for h in rnd.sample([h for h in after if after[h]], min(25, len([h for h in after if after[h]]))):
        assert abs(sum(p((*h, *w)) for w in one) + p((*h, "none such")) - 1) < 1e-9
    out = []
    for i, w, held in docs:
        log_p = sum(math.log10(p(grams(w, min(order, j + 2), j))) for j in range(len(w)))
        out.append((i, held, len(w), sum((x,) in one for x in w), n, sum(math.log10((count[1][(x,)] + 1) / (n + v + 1)) for x in w), log_p))
    return out


def texts(seed):
    rnd = random.Random(seed)
    words = [f"v{int(rnd.paretovariate(0.7))}" for _ in range(5000)]
    rows = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randrange(60)))) for k in range(150)] + [(200, None), (201, ""), (202, "x x x x x x x"), (None, "The END"), (5, "other text of five")]
    return rows + [rows[0], rows[1], (300, rows[2][1]), (301, rows[2][1]), (302, "a \x00 b \x1f c"), (303, "tail " * 400)]


def close(got, expected):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[6])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(expected, key=key), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 and abs(a[6] - b[6]) < 1e-6, (a, b)


@pytest.mark.parametrize("order,chunk,bucket,hot", [(2, 700, 300, 40), (3, 10**6, 10**6, 10**6), (4, 900, 900, 25)])
def test_against_brute_force(spark, monkeypatch, order, chunk, bucket, hot):
    for name, value in (("CHUNK", chunk), ("BUCKET", bucket), ("HOT", hot)):
        monkeypatch.setattr(katz, name, value)
    rows = texts(8)
    got = katz.score(spark.createDataFrame([(i, t, 0, "", 0.0) for i, t in rows], DOC), order=order).collect()
    close(got, brute(rows, order))
    held = [r for r in got if r.held_out]
    assert order == 1 or sum(r.score for r in held) > sum(r.base_score for r in held)  # better than the base on held-out texts


def test_query(spark, tmp_path):
    rows = [(i, t) for i, t in texts(18) if i is not None]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    close(queries.op8_katz(spark, str(tmp_path)).collect(), brute(rows, katz.ORDER))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("katz")]


def test_edges(spark):
    df = spark.createDataFrame([(6, "one two", 0, "", 0.0)], DOC)
    assert katz.score(df.limit(0)).count() == 0
    assert zlib.crc32(b"6") % 7 != 2 or katz.score(df).first()["score"] == 0.0
    out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    assert katz.score(spark.createDataFrame([(out, "one two", 0, "", 0.0)], DOC)).first()["score"] == 0.0  # nothing to learn from
    by_name = spark.createDataFrame([("a", "x y"), ("b", None), (None, "x")], "doc_id string, text string")
    assert sorted(r.doc_id or "" for r in katz.score(by_name).collect()) == ["", "a", "b"]
