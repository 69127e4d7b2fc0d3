"""Near-duplicates at other similarities than the contract's."""

import random

import pytest

import corpus_pipeline
from sylvagraph.llm import near_dup
from test_dedup import edited

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def similarity(a, b):
    x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def pairs(rnd, low, high, n):
    """n pairs of texts of a similarity in [low, high)."""
    out = []
    while len(out) < n:
        words = [f"v{rnd.randrange(10**6)}" for _ in range(rnd.randrange(100, 200))]
        pair = " ".join(words), " ".join(edited(rnd, words, rnd.randrange(1, 6)))
        if low <= similarity(*pair) < high:
            out.append(pair)
    return out


def test_the_stage_takes_similarities_from_080(spark, tmp_path):
    rnd = random.Random(4)
    near, far = pairs(rnd, 0.80, 0.85, 60), pairs(rnd, 0.72, 0.80, 20)
    texts = [t for p in near + far for t in p]
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], DOC)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, str(tmp_path)).collect()}
    assert kept == set(range(0, 120, 2)) | set(range(120, 160))
    at_contract = near_dup.near_duplicates(df).filter("kept")
    assert at_contract.count() == len(texts)


@pytest.mark.parametrize("percent", [50, 80, 85, 90])
def test_bands_and_bound_fit_the_similarity(percent):
    read, j = near_dup.band_rows(percent), percent / 100
    bands, size = read.shape
    assert sorted(read.ravel()) == sorted([*range(near_dup.MINIMA)] * 2)
    assert (1 - j**size) ** bands <= near_dup.MOST_MISSED
    deviation = (j * (1 - j) / near_dup.MINIMA) ** 0.5
    assert (j - near_dup.least_agreement(percent)) / deviation > 5
