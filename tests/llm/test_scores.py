import math
import random
from collections import Counter

from sylvagraph.llm import line_templates, quality

DOC = "doc_id bigint, text string, lang string, kept int, score double"


def quality_brute(text):
    text = text or ""
    import re

    space = " \t\n\x0b\x0c\r"
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(space)]
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {p for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for p in range(k, k + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measures(spark):
    rnd = random.Random(2)
    texts = [None, "", " ", "a\n\na\n a \n\x0b\na", "é漢🙂 #*$%&|<> x\x1cy z", "w " * 30, "one two three four five six seven eight"]
    texts += ["".join(rnd.choice(["a ", "b ", "c\n", "#", "d\t", "a b c d e f g h "]) for _ in range(rnd.randrange(90))) for _ in range(60)]
    df = spark.createDataFrame([(k, t, "en", 0, 0.0) for k, t in enumerate(texts)], DOC)
    for r in quality.measure(df).collect():
        m = r["_measures"]
        got = m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words
        assert got == quality_brute(r.text), r.text


def binomial_cdf(k, n, p):
    return sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))


def test_log_cdf(spark):
    from pyspark.sql import functions as F

    rows = [(k, n) for n in (0, 1, 20, 300) for k in (0, 1, 5, 20) if k <= n]
    df = spark.createDataFrame(rows, "k bigint, n bigint")
    for r in df.withColumn("v", quality._log_cdf(F.col("k"), F.col("n"), 0.03)).collect():
        assert abs(math.exp(r.v) - binomial_cdf(r.k, r.n, 0.03)) < 1e-9


def test_cutoffs_hold_back_without_labels_and_catch_junk_with_them(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for k in range(1600):
        bad = k % 5 == 0
        rows.append((k, " ".join(word() + ("###" if bad else "") for _ in range(30)), "en" if k < 1500 else None, 0, 0.0))
        labels.append((k, 0 if bad else 1))
    labels += [(99999, 1), (3, None), (None, 1)]
    df, marks = spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id bigint, quality int")
    got = {r.doc_id: r._kept for r in quality.quality(df, marks).collect()}
    assert all(got[k] == (k % 5 != 0) for k in range(1500))
    assert all(got[k] for k in range(1500, 1600))  # 80 good labels certify nothing
    assert all(r._kept for r in quality.quality(df, marks.limit(0)).collect())
    assert quality.quality(df.limit(0), marks).count() == 0
    cut = {r.rule: r for r in quality.calibrate(quality.measure(df), marks).collect()}
    assert set(cut) == {"symbols", "long_words"} or set(cut) == {"symbols"}
    assert cut["symbols"].lost_good == 0 and cut["symbols"].caught_bad == 300


def test_templates(spark):
    rnd = random.Random(1)
    prose = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(12))
    rows = []
    for k in range(40):
        lines = [prose(), f"Copyright {1990 + k} by the authors of this", prose(), prose()]
        if k < 20:
            lines.insert(2, f"Posted by user {prose().split()[0]} in the general section today")
        rows.append((k, "\n".join(lines), "en", 0, 0.0))
    rows += [(90, None, "en", 0, 0.0), (91, "", "en", 0, 0.0), (92, "\n\n", "en", 0, 0.0), rows[0], (None, "Copyright 1 by the authors of this\n" + prose() + "\n" + prose(), "en", 0, 0.0)]
    rows += [(100 + k, "same old line again\n" * 3, "en", 0, 0.0) for k in range(15)]
    df = spark.createDataFrame(rows, DOC)
    got = line_templates.drop_templates(df)
    assert got.columns == [*df.columns, "_dropped"] and got.count() == len(rows)
    for r in got.collect():
        if r.doc_id is None:
            assert r._dropped == [0] and "Copyright" not in r.text
        elif r.doc_id < 40:
            assert r._dropped == ([1, 2] if r.doc_id < 20 else [1]), r
            assert "Copyright" not in r.text and "Posted" not in r.text and r.text.count("\n") == 2
        elif r.doc_id == 90:
            assert r.text is None
        else:
            assert r.text == dict((a, b) for a, b, *_ in rows)[r.doc_id] and r._dropped == []
    assert line_templates.drop_templates(df.limit(0)).count() == 0
