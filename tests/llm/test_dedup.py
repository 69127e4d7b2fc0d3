import random
from collections import Counter, defaultdict

import duckdb
import pytest

from sylvagraph.llm import components, decontaminate, near_dup, queries, repeats
from sylvagraph.llm.common import text_bytes

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, kept int, n_words string"


def near_brute(rows):
    """component of each doc by full comparison."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    of = list(range(len(rows)))

    def find(k):
        while of[k] != k:
            k = of[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                of[find(a)] = find(b)
    least = defaultdict(list)
    for k, (d, _) in enumerate(rows):
        least[find(k)].append(d)
    return [(d, len(sets[k]), min((x for x in least[find(k)] if x is not None), default=None)) for k, (d, _) in enumerate(rows)]


def edited(rnd, words, n):
    out = list(words)
    for _ in range(n):
        out[rnd.randrange(len(out))] = f"w{rnd.randrange(10**6)}"
    return out


@pytest.mark.parametrize("small", [64, 2])
def test_near_duplicates_against_full_comparison(spark, monkeypatch, small):
    monkeypatch.setattr(near_dup, "SMALL", small)
    rnd = random.Random(7)
    vocabulary = [f"v{k}" for k in range(500)]
    rows = []
    for _ in range(6):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randrange(60, 300))]
        rows += [" ".join(edited(rnd, base, rnd.randrange(0, 1 + len(base) // 60))) for _ in range(14)]
    rows += [" ".join(rnd.choice(vocabulary) for _ in range(80)) for _ in range(20)] + ["", None, " \n", "one two", "ONE  two", "one two three four five", rows[0], rows[0]]
    rnd.shuffle(rows)
    rows = [(None if k == 17 else 1000 - k, t) for k, t in enumerate(rows)]
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], DOC)
    got = near_dup.near_duplicates(df).collect()
    expected = near_brute(rows)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(expected)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_rows_without_ids_link(spark):
    rnd = random.Random(4)
    base = [f"w{k}" for k in range(200)]
    rows = [(1, " ".join(base)), (None, " ".join(edited(rnd, base, 2))), (None, " ".join(edited(rnd, base, 2))), (9, " ".join(edited(rnd, base, 2)))]
    other = [f"u{k}" for k in range(200)]
    rows += [(None, " ".join(other)), (None, " ".join(other)), (None, " ".join(edited(rnd, other, 1)))]
    rows += [(5, "one text of this id with more words"), (5, " ".join(edited(rnd, base, 1)))]
    got = near_dup.near_duplicates(spark.createDataFrame([(d, t, 0, "x") for d, t in rows], DOC)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(near_brute(rows))


def test_a_group_linked_only_in_a_chain(spark):
    """Each text is near the next one only, so the hub of a bucket misses most links."""
    rnd = random.Random(11)
    words = [f"a{k}" for k in range(150)]
    rows = []
    for k in range(90):
        rows.append((k, " ".join(words)))
        words = edited(rnd, words, 1)
    got = near_dup.near_duplicates(spark.createDataFrame([(d, t, 0, "") for d, t in rows], DOC))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == Counter(near_brute(rows))


def test_components(spark):
    rnd = random.Random(3)
    pairs = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 160)] + [(7, 7)]
    of = {}

    def find(x):
        while of.setdefault(x, x) != x:
            x = of[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((find(a), find(b)))
            of[y] = x
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for x in of}
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


@pytest.mark.parametrize("name", ["op4_decontaminate", "op6_substring_dedup", "op7_suffix_dedup", "op10_chat_format"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, expected = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, expected))
    assert a.equals(b)


def repeats_brute(rows, length):
    big = float("inf")
    first = {}
    for d, t in rows:
        w = (t or "").split()
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            first[key] = min(first.get(key, big), big if d is None else d)
    out = []
    for d, t in rows:
        w, gone = (t or "").split(), set()
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < (big if d is None else d):
                gone.update(range(k, k + length))
        out.append((d, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("operator,length", [(repeats.substring, 13), (repeats.suffix, 50)])
def test_repeats_against_full_comparison(spark, operator, length):
    rnd = random.Random(length)
    vocabulary = ["the", "of", "a"] + [f"v{k}" for k in range(40)]
    passages = [[rnd.choice(vocabulary) for _ in range(rnd.randrange(length - 2, length + 30))] for _ in range(5)]
    rows = []
    for k in range(60):
        parts = [rnd.choice(passages) if rnd.random() < 0.5 else [rnd.choice(vocabulary) for _ in range(rnd.randrange(30))] for _ in range(rnd.randrange(5))]
        rows.append((rnd.randrange(1000), " ".join(x for p in parts for x in p)))
    rows += [(5, None), (6, ""), (None, " ".join(passages[0])), (None, " ".join(passages[1])), (7, "x " * 200), (8, "x " * 200), rows[3], (rows[4][0], " ".join(passages[2]))]
    df = spark.createDataFrame([(d, t, 0, "") for d, t in rows], DOC)
    got = operator(df)
    total = Counter((r.doc_id, r.n_words, r.n, r.kept) for r in got.withColumn("n", repeats.removed_words("removed")).collect())
    assert total == Counter(repeats_brute(rows, length))
    assert operator(df.limit(0)).count() == 0


@pytest.mark.parametrize("operator,length", [(repeats.substring, 13), (repeats.suffix, 50)])
def test_repeats_of_one_id_and_without_ids(spark, operator, length):
    """Rows that share an id, or have none, are judged each by its own text."""
    rnd = random.Random(length)
    own = lambda n: " ".join(f"u{rnd.randrange(10**6)}" for _ in range(n))
    shared = own(length + 5)
    rows = [(1, shared), (7, shared)] + [(7, own(length + 9)) for _ in range(300)] + [(None, own(length + 9)) for _ in range(300)]
    rows += [(None, f"{own(9)} {shared}"), (None, f"{shared} {own(9)}"), (None, own(length) + " é " * 30), (3, " ".join(["w"] * 100_000))]
    df = spark.createDataFrame([(d, t, 0, "") for d, t in rows], DOC)
    total = Counter((r.doc_id, r.n_words, r.n, r.kept) for r in operator(df).withColumn("n", repeats.removed_words("removed")).collect())
    assert total == Counter(repeats_brute(rows, length))
    with pytest.raises(TypeError):
        operator(df.selectExpr("string(doc_id) AS doc_id", "text"))


def test_neighbours_of_the_suffix_array(spark):
    """Suffixes are compared over their words, in lexicographic order, whatever the range partitions."""
    rnd = random.Random(5)
    rows = [(" ".join(rnd.choice("abc") for _ in range(4)).encode(), rnd.randrange(9), k, k, False, True) for k in range(400)]
    df = spark.createDataFrame(rows, repeats._SUFFIX)
    docs = defaultdict(set)
    for s, d, *_ in rows:
        docs[s].add(d)
    got = {(r.doc, r.row, r.at) for r in repeats._neighbours(df, 7).collect()}
    assert got == {(d, r, a) for s, d, r, a, *_ in rows if len(docs[s]) > 1}


@pytest.mark.parametrize("most", [100_000, 40])
def test_leaks_in_any_number_of_blocks(spark, most):
    rnd = random.Random(9)
    word = lambda: rnd.choice(["The", "of", "x-y", "É", "漢字"] + [f"v{k}" for k in range(60)])
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 2, 3, 9, 10, 11, 25, 40, 40, 60])] + [(3, "repeat of an item"), (None, "nobody owns these words here"), (77, None), (78, "- -")]
    docs = []
    for k in range(40):
        parts = [rnd.choice(items)[1] or "" if rnd.random() < 0.3 else " ".join(word() for _ in range(rnd.randrange(20))) for _ in range(3)]
        docs.append((k, " ".join(parts).upper() if k % 5 == 0 else ", ".join(parts)))
    docs += [(50, None), (51, ""), docs[0]]
    windows = decontaminate.item_windows([(i, None if t is None else t.encode()) for i, t in items])
    expected = []
    for d, t in docs:
        w, hit, own = decontaminate.words_of(None if t is None else t.encode()), set(), set()
        for key, ids in windows.items():
            for k in range(len(w) - len(key) + 1):
                if tuple(w[k : k + len(key)]) == key:
                    hit.update(range(k, k + len(key)))
                    own |= {str(i) for i in ids if i is not None}
        expected.append((d, len(w), len(hit), ",".join(sorted(own))))
    df = spark.createDataFrame([(d, t, 0, "") for d, t in docs], DOC)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.find_leaks(df, bench, most=most)
    rows = got.select("doc_id", "_leaks.n_words", decontaminate.covered("_leaks.spans").alias("n"), "_leaks.items", "kept").collect()
    assert Counter((r.doc_id, r.n_words, r.n, ",".join(sorted(r["items"]))) for r in rows) == Counter(expected)
    assert decontaminate.find_leaks(df, bench.limit(0)).filter("size(_leaks.spans) > 0").count() == 0
    assert decontaminate.find_leaks(df.limit(0), bench).count() == 0
    assert text_bytes("text") is not None
