"""A run of all stages against the brute-force form of each."""

import base64
import hashlib
import random

import public_tokenizers
import tiktoken

import corpus_pipeline
from sylvagraph.llm import decontaminate
from test_dedup import edited, near_brute
from test_scores import quality_brute


def test_run(spark, tmp_path):
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    words = lambda n: [word() for _ in range(n)]
    items = [(k, " ".join(words(15))) for k in range(4)]
    base = [words(240) for _ in range(3)]
    texts = [" ".join(words(rnd.randrange(25, 80))) for _ in range(30)]
    texts += [" ".join(edited(rnd, b, n)) for b in base for n in (0, 1, 2)] + [" ".join(base[0])]
    texts += [" ".join(words(30) + [items[k][1]] + words(30)) for k in range(4)]
    texts += [None, "", "too short", " ".join(words(8) * 12)]
    line = "a line that stands in many documents"
    texts = [t if k >= 15 else "\n".join([t[: len(t) // 2], line, t[len(t) // 2 :]]) for k, t in enumerate(texts)]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    rnd.shuffle(rows)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(k, 1) for k in range(5)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))

    def good(t):
        n, _, _, _, repeated = quality_brute(t)
        return n >= 20 and 100 * repeated <= 30 * n

    kept = [(d, "\n".join(x for x in t.split("\n") if x != line)) for d, t, *_ in rows if good(t)]
    kept = [(d, t) for (d, t), (_, _, least) in zip(kept, near_brute(kept), strict=True) if d == least]
    windows = decontaminate.item_windows([(i, t.encode()) for i, t in items])

    def clean(t):
        w = decontaminate.words_of(t.encode())
        return not any(tuple(w[k : k + len(x)]) == x for x in windows for k in range(len(w)))

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = {d: (sha(" ".join(map(str, library.encode_ordinary(t)))), sha(t)) for d, t in kept if clean(t)}
    assert len(expected) == 30 + 3
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id: (r.ids_sha256, r.decoded_sha256) for r in got.collect()} == expected
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.columns == docs.columns and empty.count() == 0, name
