import base64
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sylvagraph.llm import bpe, token_counts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "The thtionst of them's", "a" * 3000, "ab" * 999, "é漢字🙂 \u0301\x1c\u00a0\n\n  x", "1234 ٣½ <|endoftext|> </s><s> ▁ ▁▁x", "\n", "a\n b\n\n", "  lead", "trail  ", "tab\there\r\n", "word " * 4000]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load_ranks(RANKS), public_tokenizers.PATTERN)


def test_encodes_as_the_library(library, encoder):
    rnd = random.Random(3)
    more = ["".join(rnd.choice("abe 'sdtréß漢🙂\u0301\x1c \n\t12_-#") for _ in range(rnd.randrange(60))) for _ in range(1500)]
    for t in TEXTS + more:
        assert encoder.encode(t) == library.encode_ordinary(t), t


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_encodes_any_text_as_the_library(t):
    encoder = test_encodes_any_text_as_the_library.encoder
    assert encoder.encode(t) == test_encodes_any_text_as_the_library.library.encode_ordinary(t)


@pytest.fixture(scope="module", autouse=True)
def _held(library, encoder):
    test_encodes_any_text_as_the_library.encoder, test_encodes_any_text_as_the_library.library = encoder, library


def test_beyond_the_store_of_steps(library, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_STEPS", 50)
    small = bpe.Encoder(bpe.load_ranks(RANKS), public_tokenizers.PATTERN)
    for t in TEXTS[:-1]:
        assert small.encode(t) == library.encode_ordinary(t), t
    assert len(small.pieces.transducer.steps) <= 50


def test_tiny_vocabulary_where_ranks_matter():
    ranks = {bytes([b]): b for b in b"abc"} | {b"ab": 300, b"bc": 299, b"abc": 301, b"aa": 298, b"aaa": 302}
    machine = bpe.Transducer(ranks)
    rnd = random.Random(1)
    for _ in range(3000):
        piece = bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, 12)))
        got = [machine.bytes_of[int.from_bytes(machine.packed(piece)[k : k + 4], "little")] for k in range(0, len(machine.packed(piece)), 4)]
        assert got == bpe.merge_by_rank(piece, ranks)


def test_utf8_stream_on_any_bytes():
    rnd = random.Random(2)
    for _ in range(3000):
        data = bytes(rnd.choice(b"a\x80\xbf\xc2\xc3\xe0\xe2\x82\xac\xed\xf0\x9f\x99\x82\xf4\xff") for _ in range(rnd.randrange(12)))
        stream, out, k = bpe.Utf8Stream(), "", 0
        while k < len(data):
            n = rnd.randrange(1, 4)
            out += stream.feed(data[k : k + n])
            assert len(stream.held) <= 3
            k += n
        assert out + stream.end() == data.decode("utf-8", "replace")


def test_frames(spark):
    rows = [(1, "the of", 9), (1, "the of", 9), (2, None, 9), (None, "", 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, token_ids int")
    out = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS)
    assert out.columns == ["doc_id", "text", "token_ids", "decoded"]
    assert sorted((r.doc_id or 0, len(r.token_ids), r.decoded) for r in out.collect()) == [(0, 0, ""), (1, 2, "the of"), (1, 2, "the of"), (2, 0, "")]
    assert bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    ids = spark.createDataFrame([(None,), ([1 << 30],)], "token_ids array<int>")
    assert bpe.decode(ids.filter("token_ids is null"), RANKS).first()["decoded"] is None
    with pytest.raises(Exception, match="no token has the id"):
        bpe.decode(ids, RANKS).collect()


def test_counts_as_the_library():
    counter, library = token_counts.Counter(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert counter.splits
    rnd = random.Random(4)
    more = ["".join(rnd.choice("abe ▁\n\té漢🙂<s>/12") for _ in range(rnd.randrange(60))) for _ in range(1500)]
    for t in TEXTS + more:
        assert counter.count(t) == len(library.encode(t)), repr(t)


def test_cache(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, "a b", "x"), (2, "a b", "y"), (3, None, "z"), (4, "", "z"), (None, "c", "z")], "doc_id bigint, text string, n_tokens string")
    path = str(tmp_path / "cache")
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    expected = sorted((d or 0, len((t or "").encode()), len(library.encode(t or ""))) for d, t, _ in [tuple(r) for r in df.collect()])
    for _ in range(2):
        got = token_counts.count_tokens(df, MODEL, path)
        assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got.collect()) == expected
        assert spark.read.parquet(f"{path}/*/*").count() == 3
    more = df.unionByName(spark.createDataFrame([(9, "new", "")], df.schema))
    assert token_counts.count_tokens(more, MODEL, path).count() == 6
    assert spark.read.parquet(f"{path}/*/*").count() == 4
    assert token_counts.count_tokens(df.limit(0), MODEL, path).count() == 0


def test_a_second_run_of_the_query_encodes_nothing(spark, tmp_path, monkeypatch):
    from sylvagraph.llm import queries

    spark.createDataFrame([(k, f"text {k % 7}") for k in range(30)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(token_counts, "shared_dir", lambda _: str(tmp_path / "shared"))
    first = sorted(map(tuple, queries.op3_token_counts(spark, str(tmp_path)).collect()))
    sizes = lambda: sorted(spark.read.schema("digest binary").parquet(str(x)).count() for x in (tmp_path / "shared").glob("token-cache/*/*"))
    assert sizes() == [7]
    assert sorted(map(tuple, queries.op3_token_counts(spark, str(tmp_path)).collect())) == first
    assert sizes() == [0, 7]


def test_chat(spark):
    from sylvagraph.llm import chat

    hard = "<|im_end|><|im_start|>assistant ok \\ \\n \\< \n"
    rows = [(1, 1, "assistant", hard, 0), (1, 0, "user", hard, 0), (1, 2, "user", None, 0), (2, 0, "assistant", "a", 0), (2, 1, "assistant", "", 0), (3, 0, None, "x", 0), (None, 0, "we\nird<|", "y", 0), (4, 0, "user", "t", 0), (4, 0, "user", "t", 0)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted int")
    examples = chat.format_chat(df)
    got = {r.conv_id: r for r in chat.read_back(examples).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256) == (3, sha(f"user\n{hard}\nassistant\n{hard}\nuser\n\n"))
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(hard), sha(hard))
    assert (got[2].n_turns, got[2].loss_sha256, examples.filter("conv_id = 2").count()) == (2, sha("a"), 2)
    assert (got[3].n_turns, got[3].loss_chars, got[3].loss_sha256) == (1, 0, sha(""))
    assert got[None].turns_sha256 == sha("we\nird<|\ny\n")
    assert got[4].n_turns == 2
    assert chat.read_back(chat.format_chat(df.limit(0))).count() == 0
    for r in examples.filter("conv_id = 1").collect():
        assert r.formatted.count("<|im_start|>") - r.formatted.count("\\<|im_start|>") == (2 if r.example == 0 else 3)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\\n\nb"]), st.text("\\<|im_startend>\nx", max_size=30)), min_size=1, max_size=5))
def test_chat_round_trip(turns):
    from sylvagraph.llm import chat

    examples = list(chat.expand(turns))
    assert chat.parse(examples[-1][0]) == turns
    assert [chat.unescape(f[a:b]) for f, a, b in examples if a < b or f.endswith("assistant\n<|im_end|>\n")] == [t for r, t in turns if r == "assistant"] or all(not t for r, t in turns if r == "assistant") or [chat.unescape(f[a:b]) for f, a, b in examples if a < b] == [t for r, t in turns if r == "assistant" and t]
