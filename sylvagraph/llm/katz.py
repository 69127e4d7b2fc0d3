"""Language-model scores by Katz backoff over n-grams of any order.

Tokens are the lower-cased words of a text and one end; a text's first token has a begin before it. For counts r up to
GT_MOST, Good-Turing discounts d_k(r) = ((r+1) n(r+1) / (r n(r)) - A) / (1 - A) with A = (GT_MOST+1) n(GT_MOST+1) / n(1)
hold, from the counts n of k-grams by count; larger counts stay. With g = (h, w) and h' = h without its first word:
  p(w)     = d_1(c(w)) c(w) / N; what the discounts free is the probability of the unknown token
  p(w | h) = d_k(c(g)) c(g) / c(h) if g was seen in training, else bow(h) p(w | h'); bow = 1 for an unseen h
  bow(h)   = (1 - sum of p(w | h)) / (1 - sum of p(w | h')), both over the words seen after h: each p(. | h) sums to 1
A context of which no discount frees anything has its p(w | h) scaled by c(h) / (c(h) + 1), to leave some for others.
Every n-gram of the training texts counts, those seen once too.

How it runs. Texts become chunks of about CHUNK tokens, written once. Order by order, every chunk sends its distinct
n-grams, packed, to buckets by context; a bucket adds up counts and answers each chunk with the counts of its n-grams and
with what the backoff weights of its contexts need: how many words follow by count, and by the count of the shorter
n-gram. A context of more than HOT tokens is dealt out by its words too, to as many buckets as its count asks for, and
what those find is added up by a join; its count is known from the order before, so nothing is listed or broadcast. A
chunk sends a row to a bucket only if it has n-grams for it, so rows never outnumber n-grams. With all answers, a chunk
is scored by recursion over orders. The result is written, and everything else removed.

Words are known by 64-bit hashes, inside a context by 48 bits; n-grams are told apart by 64-bit hashes of these.

Defined cases: null and empty texts consist of the end alone; a row without an id is in training, as it has no
remainder; without training data every token is unknown, with probability 1; repeated rows count and are scored each;
columns beside id and text aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, hashed_words, mix, text_bytes, tune

HELD_OUT_OF, HELD_OUT = 7, 2
ORDER = 2
GT_MOST = 5
CHUNK = 500_000
#: n-grams that a bucket gets, at most about, copies from several chunks included.
BUCKET = 1_500_000
#: Tokens from which a context's words are dealt out to several buckets.
HOT = 200_000
#: Parts, by contexts, in which the n-grams of an order from 3 on are counted one after the other: less is on disk at once.
SLICES = 3
_END = np.uint64(0x9E3779B97F4A7C15)
_BEGIN = np.uint64(0xC2B2AE3D27D4EB4F)
_STEP = np.uint64(0x9E3779B185EBCA87)
_TOP = np.uint64(32)


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % HELD_OUT_OF == HELD_OUT


def discounts(n: list[int]) -> list[float]:
    """d(0..GT_MOST) from counts of counts n(0..GT_MOST+1); where these are too few for Good-Turing, half a count goes."""
    half = [0.0] + [(r - 0.5) / r for r in range(1, GT_MOST + 1)]
    if not all(n[1:]):
        return half
    a = (GT_MOST + 1) * n[GT_MOST + 1] / n[1]
    if a >= 1:
        return half
    d = [0.0] + [((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, GT_MOST + 1)]
    return d if all(0 < x < 1 for x in d[1:]) else half


def _pack(x: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes as the largest needs, bytes of equal weight side by side, compressed."""
    high = int(x.max()) if len(x) else 0
    size = 1 if high < 1 << 8 else 2 if high < 1 << 16 else 4 if high < 1 << 32 else 8
    raw = np.ascontiguousarray(x.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T).tobytes()
    return struct.pack("<BQ", size, len(x)) + pa.compress(raw, "zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    size, n = struct.unpack_from("<BQ", data)
    raw = pa.decompress(data[9:], size * n, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(f"<u{size}").ravel().astype(np.uint64)


def _pack_words(x: np.ndarray) -> bytes:
    """The upper 48 bits, six bytes each; hashes don't compress."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def _unpack_words(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _slice(contexts: np.ndarray) -> np.ndarray:
    return contexts % np.uint64(SLICES)


def _spans(keys: np.ndarray) -> list[tuple[int, int]]:
    """Runs of equal keys, none of which is negative."""
    edges = np.flatnonzero(np.diff(keys, prepend=-1))
    return list(zip(edges.tolist(), [*edges[1:].tolist(), len(keys)], strict=True)) if len(edges) else []


def _chunked(docs: DataFrame) -> DataFrame:
    """part, doc_ids, lengths, words (sorted hashes, with the begin and the end), tokens (places among the words)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, total = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        held: list[np.ndarray] = []
        kind = None

        def row() -> pa.RecordBatch:
            words, tokens = np.unique(np.concatenate([*held, np.array([_BEGIN, _END])]), return_inverse=True)
            cells = [[task << 32 | seq], [ids], [[len(x) for x in held]], [_pack(np.diff(words, prepend=np.uint64(0)))], [_pack(tokens[:-2])]]
            types = [pa.int64(), pa.list_(kind), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], names=["part", "doc_ids", "lengths", "words", "tokens"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for doc, words in zip(batch.column(0).to_pylist(), hashed_words((x.as_py() for x in batch.column(1)), True), strict=True):
                held.append(np.append(words, _END))
                ids.append(doc)
                total += len(held[-1])
                if total >= CHUNK:
                    yield row()
                    seq, total = seq + 1, 0
                    ids, held = [], []
        if ids:
            yield row()

    return docs.mapInArrow(run, f"part bigint, doc_ids array<{id_type}>, lengths array<int>, words binary, tokens binary")


class Model:
    """The few numbers that all tasks share, by order."""

    def __init__(self) -> None:
        self.d: list[list[float]] = [[]]
        self.n = self.v = 0

    def learn(self, stats: list[int]) -> None:
        """stats: n(1..GT_MOST+1) of the next order, distinct n-grams, all n-grams."""
        self.d.append(discounts([0, *stats[: GT_MOST + 1]]))
        if len(self.d) == 2:
            self.v, self.n = stats[GT_MOST + 1], stats[GT_MOST + 2]
            freed = sum((1 - self.d[1][r]) * r * stats[r - 1] for r in range(1, GT_MOST + 1))
            # without any small counts, one token's worth is kept back for the unknown one
            self.scale = (1.0 if freed > 0 else self.n / (self.n + 1)) / max(self.n, 1)
            self.unknown = 1.0 if not self.n else freed / self.n if freed > 0 else 1 / (self.n + 1)

    def cut(self, k: int, c: np.ndarray) -> np.ndarray:
        """Discounted counts of k-grams."""
        return np.where(c <= GT_MOST, np.array(self.d[k])[np.minimum(c, GT_MOST)], 1.0) * c


    def backed(self, k: int, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What discounts free, and the discounted counts of the shorter n-grams, by context. Rows of `seen`: words after
        a context by count 1..GT_MOST, by shorter count 1..GT_MOST, sum of the larger shorter counts."""
        # plain sums: a matrix product would start threads
        freed = sum((1 - self.d[k][r]) * r * seen[r - 1].astype(np.float64) for r in range(1, GT_MOST + 1))
        mass = seen[-1] + sum(self.d[k - 1][r] * r * seen[GT_MOST + r - 1].astype(np.float64) for r in range(1, GT_MOST + 1))
        return freed, mass


class Level:
    """The distinct k-grams of a chunk, by context hash and word hash."""

    context: np.ndarray  # of each n-gram: the place of its context among `contexts`
    contexts: np.ndarray  # sorted hashes
    word: np.ndarray  # of each n-gram: its last word's place
    shorter: np.ndarray  # of each n-gram: the place of the n-gram without its first word, in the level before
    of_token: np.ndarray  # of each token: its n-gram, -1 if the text has too few words before it
    count: np.ndarray  # of each n-gram, in training; and of its context
    of_context: np.ndarray
    freed: np.ndarray  # of each context: what discounts take from the counts after it
    mass: np.ndarray  # of each context: discounted counts of the shorter n-grams of the words seen after it


class Chunk:
    def __init__(self, row: dict):
        self.part, self.ids, self.lengths = row["part"], row["doc_ids"], np.asarray(row["lengths"])
        self.words = np.cumsum(_unpack(row["words"]), dtype=np.uint64)
        self.tokens = _unpack(row["tokens"]).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.train = np.repeat(np.array([not held_out(i) for i in self.ids], bool), self.lengths)
        self.levels: list[Level | None] = [None]
        self._place, self._hash = self.tokens, self.words  # of the last level, in the order of its hashes

    def extend(self, only: int | None = None, last: bool = False) -> Level:
        """Adds the next level, or its slice `only`; the last one needs no place in hash order."""
        k, n = len(self.levels), len(self.words)
        level = Level()
        if k == 1:
            level.context, level.contexts, level.word = np.zeros(n, np.int64), np.zeros(1, np.uint64), np.arange(n)
            level.shorter, level.of_token, level.of_context = np.zeros(n, np.int64), self.tokens, np.full(1, 1 << 62)
            self.levels.append(level)
            return level
        lower = self.levels[-1]
        before = np.empty(len(self.tokens), np.int64)
        before[1:] = self._place[:-1]
        if k == 2:
            before[self.starts] = np.searchsorted(self.words, _BEGIN)
            at = np.arange(len(self.tokens))
            known = lower.count.copy()
            known[np.searchsorted(self.words, _BEGIN)] = known[np.searchsorted(self.words, _END)]  # one of each a text
        else:
            valid = np.ones(len(self.tokens), bool)
            for j in range(k - 2):
                valid[self.starts[self.lengths > j] + j] = False
            at = np.flatnonzero(valid)
            if only is not None:
                at = at[_slice(self._hash)[before[at]] == only]
            known = lower.count[self._by_hash]
        keys, inverse = np.unique(before[at] * n + self.tokens[at], return_inverse=True)
        contexts = keys // n
        level.word = keys - contexts * n
        new = np.diff(contexts, prepend=-1) > 0
        used, level.context = contexts[new], np.cumsum(new) - 1
        level.contexts, level.of_context = self._hash[used], known[used]
        level.of_token = np.full(len(self.tokens), -1)
        level.of_token[at] = inverse
        level.shorter = np.empty(len(keys), np.int64)
        level.shorter[inverse] = lower.of_token[at]
        self.levels.append(level)
        if last:
            return level
        # ids of the next level's contexts, in the order of their hashes
        hashes = mix(level.contexts[level.context] * _STEP + self.words[level.word])
        self._by_hash = np.argsort(hashes)
        rank = np.empty(len(keys), np.int64)
        rank[self._by_hash] = np.arange(len(keys))
        self._place, self._hash = np.full(len(self.tokens), -1), hashes[self._by_hash]
        self._place[at] = rank[inverse]
        return level

    def dealt(self, k: int, buckets: int, slice_: int = 0) -> tuple:
        """For a slice: (n-grams of plain contexts, their buckets), (n-grams of hot contexts, theirs); in the order of
        buckets."""
        level = self.levels[k]
        base = ((level.contexts >> _TOP) * np.uint64(buckets) >> _TOP).astype(np.int64)
        splits = np.minimum(-(-level.of_context // HOT), buckets)
        own = _slice(level.contexts) == slice_ if k > 2 else np.ones(len(base), bool)
        plain, hot = np.flatnonzero((own & (splits <= 1))[level.context]), np.flatnonzero((own & (splits > 1))[level.context])
        at = level.context[hot]
        bucket = (base[at] + ((mix(self.words[level.word[hot]]) >> _TOP) * splits[at].astype(np.uint64) >> _TOP).astype(np.int64)) % buckets
        order = np.argsort(bucket, kind="stable")
        return (plain, base[level.context[plain]]), (hot[order], bucket[order])

    def told(self, k: int, buckets: int, answers: list[dict], hot: list[dict] | None, model: Model | None) -> None:
        """Takes in the answers to a level; what backoff needs too, if the model is known."""
        level = self.levels[k]
        level.count = np.zeros(len(level.word), np.int64)
        level.freed, level.mass = np.zeros(len(level.contexts)), np.zeros(len(level.contexts))
        answers = sorted(answers or [], key=lambda x: (x["slice"], x["hot"], x["bucket"]))
        for slice_ in range(SLICES if k > 2 else 1):
            for is_hot, (grams, _) in zip((False, True), self.dealt(k, buckets, slice_), strict=True):
                own = [x for x in answers if x["hot"] == is_hot and x["slice"] == slice_]
                if own:
                    level.count[grams] = np.concatenate([_unpack(x["a"]) for x in own])
                    if model and not is_hot and k > 1:
                        at = level.context[grams]
                        at = at[np.flatnonzero(np.diff(at, prepend=-1))]
                        both = [model.backed(k, _unpack(x["b"]).reshape(2 * GT_MOST + 1, -1)) for x in own]
                        level.freed[at], level.mass[at] = (np.concatenate(x) for x in zip(*both, strict=True))
        if model and hot:
            at = np.searchsorted(level.contexts, np.array([x["key"] for x in hot], np.int64).view(np.uint64))
            level.freed[at], level.mass[at] = model.backed(k, np.array([x["n"] for x in hot], np.int64).T)

    def log_p(self, model: Model) -> np.ndarray:
        """log10 of each token's probability, by recursion over the orders."""
        base = self.levels[1]
        p = model.cut(1, base.count) * model.scale
        logs = np.log10(np.where(base.count > 0, p, model.unknown))
        of_token = logs[base.of_token]
        scale = np.full(1, model.scale)
        for k, level in enumerate(self.levels[2:], 2):
            c = np.maximum(level.of_context, 1)
            share = np.where(level.freed > 1e-9 * c, 1.0, c / (c + 1))
            some = np.empty(len(level.contexts), np.int64)
            some[level.context] = np.arange(len(level.word))  # an n-gram of each context
            lower = self.levels[k - 1]
            shorter = scale[lower.context[level.shorter[some]]]
            mass = shorter * level.mass
            bow = np.where(level.of_context > 0, (1 - share * (c - level.freed) / c) / (1 - mass), 1.0)
            scale = share / c
            back = np.log10(bow)[level.context] + logs[level.shorter]
            with np.errstate(divide="ignore"):
                logs = np.where(level.count > 0, np.log10(scale[level.context] * model.cut(k, level.count)), back)
            has = level.of_token >= 0
            of_token[has] = logs[level.of_token[has]]
        return of_token


def _chunks(batches: Iterable[pa.RecordBatch], upto: int, buckets: list[int], model: Model | None = None) -> Iterator[Chunk]:
    """Chunks with the answers to the first `upto` levels taken in."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            chunk = Chunk(row)
            for level in range(1, upto + 1):
                chunk.extend(last=model is not None and level == upto)
                chunk.told(level, buckets[level], row.pop(f"answers{level}"), row.pop(f"hot{level}"), model)
            yield chunk


_SENT = "part bigint, slice int, bucket bigint, hot boolean, contexts binary, sizes binary, words binary, counts binary, shorter binary"


def _sent(met: DataFrame, k: int, buckets: list[int], slice_: int) -> DataFrame:
    """The distinct k-grams of all chunks, of one slice of the contexts, packed by bucket."""
    schema = pa.schema([("part", pa.int64()), ("slice", pa.int32()), ("bucket", pa.int64()), ("hot", pa.bool_()), *[(c, pa.binary()) for c in ("contexts", "sizes", "words", "counts", "shorter")]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, k - 1, buckets):
            level = chunk.extend(slice_ if k > 2 else None, True)
            counts = np.bincount(level.of_token[chunk.train & (level.of_token >= 0)], minlength=len(level.word))
            lower = chunk.levels[k - 1].count if k > 1 else np.zeros(len(level.word), np.int64)
            rows = []
            for hot, (grams, bucket) in zip((False, True), chunk.dealt(k, buckets[k], slice_), strict=True):
                for a, b in _spans(bucket):
                    own = grams[a:b]
                    first = np.flatnonzero(np.diff(level.context[own], prepend=-1))
                    contexts = level.contexts[level.context[own[first]]]
                    rows.append((chunk.part, slice_, int(bucket[a]), hot, _pack(np.diff(contexts, prepend=np.uint64(0))), _pack(np.diff(np.append(first, len(own)))), _pack_words(chunk.words[level.word[own]]) if k > 1 else chunk.words[own].tobytes(), _pack(counts[own]), _pack(lower[level.shorter[own]])))
            del chunk, level
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return met.mapInArrow(run, _SENT)


ANSWERS, HOTS, COUNTS = 0, 1, 2
_ANSWER = "kind int, key bigint, slice int, bucket bigint, hot boolean, a binary, b binary, n array<bigint>, parts array<bigint>"


def _answered(rows: DataFrame, k: int) -> DataFrame:
    """By bucket. ANSWERS: to each chunk (key) the counts of its k-grams, and for its plain contexts what Model.backed
    needs; HOTS: the bucket's share in that of each hot context (key), and the chunks that ask; COUNTS: for Model.learn."""
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("slice", pa.int32()), ("bucket", pa.int64()), ("hot", pa.bool_()), ("a", pa.binary()), ("b", pa.binary()), ("n", pa.list_(pa.int64())), ("parts", pa.list_(pa.int64()))])

    def run(table: pa.Table) -> pa.Table:
        slice_, bucket = table.column("slice")[0].as_py(), table.column("bucket")[0].as_py()
        parts, hot = table.column("part").to_numpy(), table.column("hot").to_pylist()
        contexts = [np.cumsum(_unpack(x.as_py()), dtype=np.uint64) for x in table.column("contexts")]
        sizes = np.concatenate([_unpack(x.as_py()) for x in table.column("sizes")]).astype(np.int64)
        words = b"".join(x.as_py() for x in table.column("words"))
        words = _unpack_words(words) if k > 1 else np.frombuffer(words, np.uint64)
        count = [_unpack(x.as_py()).astype(np.int64) for x in table.column("counts")]
        shorter = np.concatenate([_unpack(x.as_py()) for x in table.column("shorter")]).astype(np.int64)
        n_grams, n_contexts = [len(x) for x in count], [len(x) for x in contexts]
        known, place = np.unique(np.concatenate(contexts), return_inverse=True)
        context = np.repeat(place, sizes)
        keys = mix(words ^ mix(known + _STEP)[context])
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        total = np.add.reduceat(np.concatenate(count)[order], first)
        of_each = np.empty(len(order), np.int64)
        of_each[order] = np.repeat(total, np.diff(np.append(first, len(order))))
        one = order[first][total > 0]
        total = total[total > 0]
        at, low, m = context[one], shorter[one], len(known)
        seen = np.array([np.bincount(at[x == r], minlength=m) for x in (total, low) for r in range(1, GT_MOST + 1)] + [np.bincount(at, np.where(low > GT_MOST, low, 0), m).astype(np.int64)])
        answers = []
        ends, context_ends = np.cumsum(n_grams), np.cumsum(n_contexts)
        for j, part in enumerate(parts.tolist()):
            own = seen[:, place[context_ends[j] - n_contexts[j] : context_ends[j]]]
            answers.append((ANSWERS, part, slice_, bucket, hot[j], _pack(of_each[ends[j] - n_grams[j] : ends[j]]), None if hot[j] or k == 1 else _pack(own.ravel()), None, None))
        if k > 1 and any(hot):
            row = np.repeat(np.arange(len(parts)), n_contexts)
            asked = np.flatnonzero(np.array(hot)[row])
            asked = asked[np.argsort(place[asked], kind="stable")]
            for a, b in _spans(place[asked]):
                c = place[asked[a]]
                answers.append((HOTS, int(known[c].view(np.int64)), slice_, bucket, True, None, None, seen[:, c].tolist(), parts[row[asked[a:b]]].tolist()))
        by_count = np.bincount(np.minimum(total, GT_MOST + 2), minlength=GT_MOST + 3)[1 : GT_MOST + 2].tolist()
        answers.append((COUNTS, 0, slice_, bucket, False, None, None, [*by_count, len(total), int(total.sum())], None))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*answers, strict=True), schema, strict=True)], schema=schema)

    return rows.groupBy("bucket").applyInArrow(run, _ANSWER)


def _scored(met: DataFrame, model: Model, order: int, buckets: list[int], id_type: str) -> DataFrame:
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(id_type)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = arrow or batch.schema.field("doc_ids").type.value_type
            for chunk in _chunks([batch], order, buckets, model):
                own = chunk.levels[1].count[chunk.tokens]
                sums = [np.add.reduceat(x, chunk.starts) for x in ((own > 0).astype(np.int64), np.log10((own + 1) / (model.n + model.v + 1)), chunk.log_p(model))]
                cells = [pa.array(chunk.ids, kind), pa.array([held_out(i) for i in chunk.ids], pa.bool_()), pa.array(chunk.lengths.astype(np.int64)), pa.array(sums[0]), pa.array(np.full(len(chunk.ids), model.n)), pa.array(sums[1]), pa.array(sums[2])]
                yield pa.RecordBatch.from_arrays(cells, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return met.mapInArrow(run, f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def score(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = documents.sparkSession
    tune(spark)
    shared = Shared(spark, "katz")
    docs = documents.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("data"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    tokens = (docs.agg(F.sum(F.octet_length("data"))).first()[0] or 0) / 6  # words are longer than five bytes
    parts = max(1, math.ceil(tokens / CHUNK))
    buckets = [0, *[max(1, math.ceil(tokens / BUCKET / (SLICES if k > 2 else 1))) for k in range(1, order + 1)]]
    name = f"katz_chunks_{uuid.uuid4().hex}"  # bucketed, so that chunks don't move when they meet their answers
    _chunked(docs).write.bucketBy(parts, "part").option("compression", "zstd").option("path", shared.path("chunks")).saveAsTable(name)
    met, model = spark.table(name), Model()
    for k in range(1, order + 1):
        slices, paths = SLICES if k > 2 else 1, []
        for s in range(slices):
            sent = _sent(met, k, buckets, s).repartition(buckets[k], "bucket")
            shared.write(_answered(sent, k), f"answers{k}-{s}", "zstd")
            paths.append(shared.path(f"answers{k}-{s}"))
            del sent
            shared.release()
        answers = spark.read.schema(_ANSWER).parquet(*paths)
        sums = answers.filter(F.col("kind") == COUNTS).agg(*[F.sum(F.col("n")[j]).alias(f"n{j}") for j in range(GT_MOST + 3)]).first()
        model.learn([x or 0 for x in sums])
        back = answers.filter(F.col("kind") == ANSWERS).withColumnRenamed("key", "part").repartition(parts, "part").groupBy("part").agg(F.collect_list(F.struct("slice", "bucket", "hot", "a", "b")).alias(f"answers{k}"))
        hot = answers.filter(F.col("kind") == HOTS)
        whole = hot.groupBy("key").agg(F.array(*[F.sum(F.col("n")[j]) for j in range(2 * GT_MOST + 1)]).alias("n"))
        asked = hot.select("key", F.explode("parts").alias("part")).distinct()
        hot = asked.join(whole, "key").groupBy("part").agg(F.collect_list(F.struct("key", "n")).alias(f"hot{k}"))  # of a chunk's own contexts
        met = met.join(back, "part", "left").join(shared.write(hot, f"hot{k}"), "part", "left")
    result = shared.write(_scored(met, model, order, buckets, id_type), "scores")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    for x in ["chunks", *[f"answers{k}-{s}" for k in range(1, order + 1) for s in range(SLICES)], *[f"hot{k}" for k in range(1, order + 1)]]:
        shared.drop(x)
    shared.release()
    return result
