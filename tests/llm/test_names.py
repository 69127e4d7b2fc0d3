"""Columns of any name pass unchanged, through operators and stages."""

import pytest

import corpus_pipeline
import public_tokenizers
from sylvagraph.llm import bpe, chat, decontaminate, line_templates, near_dup, quality, queries, token_counts

NAMES = "_text_bytes text_bytes ids _ids _measures _cut _cutoffs _stratum _kept kept _dropped _leaks _id _row _numbers _words _own _doc doc key id stratum data cls row part known".split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, f"A plain text of number {k} with more than enough words to be kept by any rule that is in use here, as far as they go on", "en", "s", 5, *range(len(NAMES))) for k in range(6)]
    rows += [(None, None, None, None, None, *range(len(NAMES))), (7, "", "en", "s", 0, *range(len(NAMES)))]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} int" for n in NAMES))


def same(df, docs):
    columns = [*NAMES, "lang"]
    expected = {tuple(r) for r in docs.select("doc_id", *columns).collect()}
    return {tuple(r) for r in df.select("doc_id", *columns).collect()} <= expected


def test_operators(spark, docs):
    ranks = public_tokenizers.path(queries.BPE_RANKS)
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    decoded = bpe.decode(encoded, ranks)
    assert decoded.columns == [*docs.columns, "token_ids", "decoded"] and same(decoded, docs)
    assert {r.doc_id: r.decoded for r in decoded.collect()} == {r.doc_id: r.text or "" for r in docs.collect()}
    cut = line_templates.drop_templates(docs)
    assert cut.columns == [c for c in docs.columns if c != "_dropped"] + ["_dropped"]
    found = decontaminate.find_leaks(docs.drop("_leaks"), spark.createDataFrame([(1, "no such words")], "item_id bigint, text string"))
    assert found.count() == docs.count()
    assert near_dup.near_duplicates(docs).count() == docs.count()
    labels = spark.createDataFrame([(1, 1), (None, None)], "doc_id bigint, quality int")
    assert same(quality.passed(docs, labels), docs) and quality.quality(docs, labels).count() == docs.count()
    assert token_counts.count_tokens(docs, public_tokenizers.path(queries.PIECE_MODEL)).count() == docs.count()
    turns = docs.selectExpr("doc_id AS conv_id", "0 AS turn", "lang AS role", "text", "_kept")
    assert chat.read_back(chat.format_chat(turns)).count() == docs.select("doc_id").distinct().count()


def test_stages(spark, docs, tmp_path):
    spark.createDataFrame([(1, "no such words")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and same(out, docs), name
