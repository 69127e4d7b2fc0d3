"""Benchmark decontamination by a prefix-filtered join of item windows with document shingles.

A window is a run of `window` words of an item (an item of fewer words is one window). All shingles of a window must
stand in a document that contains it, so one of them, its rarest over all documents, is a sufficient prefix: that
shingle's occurrences are joined with the windows that have chosen it. The shingle's place in the window gives the
only possible start (positional bound), which must leave room for the whole window (length bound); then all words are
compared.

Windows are broadcast in blocks of at most MOST_WINDOWS, so what a task holds is bounded; a benchmark of more windows
takes one pass over the documents for each block, and what is found is carried along in a column.

Defined cases: null texts and texts without words have no words, no hits and no windows; an item whose id is null marks
words but isn't named; repeated items count once by id; repeated documents give a row each; an empty benchmark marks
nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, WordHash, signed, tune, window_hashes

WINDOW, SHINGLE = 10, 3
MOST_WINDOWS = 100_000

#: Lower-cases A-Z, keeps a-z, 0-9 and all bytes of other characters, makes the rest a space.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORDS = WordHash()


def words_of(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(_TO_WORDS).split()


def _shingles(words: list[bytes], size: int) -> np.ndarray:
    return window_hashes(_WORDS.of(words), size)


def item_windows(items: Iterable[tuple], window: int = WINDOW) -> dict[tuple[bytes, ...], set]:
    """window words -> ids of the items that have it."""
    found: dict[tuple[bytes, ...], set] = defaultdict(set)
    for item, data in items:
        words = words_of(data)
        for k in range(max(1, len(words) - window + 1) if words else 0):
            found[tuple(words[k : k + window])].add(item)
    return found


def _find(sorted_keys: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in `hashes` of known keys, and the keys' places."""
    if not len(sorted_keys) or not len(hashes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.searchsorted(sorted_keys, hashes)
    at[at == len(sorted_keys)] = 0
    hit = np.flatnonzero(sorted_keys[at] == hashes)
    return hit, at[hit]


def _counts(docs: DataFrame, keys: dict[int, np.ndarray]) -> dict[tuple[int, int], int]:
    """How often each of the benchmark's shingles (by size) stands in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        seen = {size: np.zeros(len(k), np.int64) for size, k in own.items()}
        for batch in batches:
            for x in batch.column(0):
                words = words_of(x.as_py())
                for size, k in own.items():
                    at = _find(k, _shingles(words, size))[1]
                    if len(at):
                        np.add.at(seen[size], at, 1)
        for size, n in seen.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), size, np.int32)), pa.array(signed(own[size][some])), pa.array(n[some])], names=["size", "shingle", "n"])

    counted = docs.mapInArrow(run, "size int, shingle bigint, n bigint").groupBy("size", "shingle").agg(F.sum("n").alias("n"))
    return {(r["size"], r["shingle"] & (1 << 64) - 1): r["n"] for r in counted.toArrow().to_pylist()}  # at most the benchmark's own shingles


def _index(windows: list[tuple[tuple[bytes, ...], set]], docs: DataFrame) -> dict[int, tuple[np.ndarray, list]]:
    """size -> (sorted shingles, for each the (offset, words, item ids) of the windows that have chosen it)."""
    sizes = [min(SHINGLE, len(w)) for w, _ in windows]
    shingles = [_shingles(list(w), s) for (w, _), s in zip(windows, sizes, strict=True)]
    keys = {s: np.unique(np.concatenate([x for x, t in zip(shingles, sizes, strict=True) if t == s])) for s in set(sizes)}
    counts = _counts(docs, keys)
    chosen: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
    for (words, items), size, own in zip(windows, sizes, shingles, strict=True):
        _, key, offset = min((counts.get((size, int(h)), 0), int(h), k) for k, h in enumerate(own))
        chosen[size][key].append((offset, words, sorted(str(i) for i in items if i is not None)))
    return {size: (np.array(sorted(by), np.uint64), [by[k] for k in sorted(by)]) for size, by in chosen.items()}


def hits(words: list[bytes], index: dict[int, tuple[np.ndarray, list]]) -> tuple[list[tuple[int, int]], set[str]]:
    """Spans of words that are occurrences of windows, and the items concerned."""
    spans, items = set(), set()
    for size, (keys, windows) in index.items():
        for pos, at in zip(*(x.tolist() for x in _find(keys, _shingles(words, size))), strict=True):
            for offset, window, ids in windows[at]:
                start = pos - offset
                if start >= 0 and start + len(window) <= len(words) and tuple(words[start : start + len(window)]) == window:
                    spans.add((start, start + len(window)))
                    items.update(ids)
    return sorted(spans), items


def merge_spans(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(end, merged[-1][1])
        else:
            merged.append((start, end))
    return merged


FOUND = "struct<n_words: bigint, spans: array<bigint>, items: array<string>>"
_FOUND_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def _pass(docs: DataFrame, index: dict, text_col: str, into: str) -> DataFrame:
    """Adds what one block finds to the column `into`: n_words, merged spans (start, end, start, ...), item ids."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kept = [c for c in docs.columns if c != into]
    source = docs.select(*kept, F.col(into))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 1024):
                batch = whole.slice(begin, 1024)
                out = []
                for x, before in zip(batch.column(kept.index(text_col)), batch.column(len(kept)).to_pylist(), strict=True):
                    words = words_of(None if (t := x.as_py()) is None else t.encode() if isinstance(t, str) else t)
                    spans, items = hits(words, shared.value)
                    if before is not None:
                        spans += zip(before["spans"][::2], before["spans"][1::2], strict=True)
                        items.update(before["items"])
                    out.append({"n_words": len(words), "spans": [p for s in merge_spans(spans) for p in s], "items": sorted(items)})
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(out, _FOUND_ARROW)], names=[*kept, into])

    return source.mapInArrow(run, source.schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, into: str = "_leaks", most: int = MOST_WINDOWS) -> DataFrame:
    """The documents with a struct column `into`: n_words, spans, items."""
    tune(docs.sparkSession)
    items = benchmark.select(F.col(item_col).alias("i"), F.col(item_text).cast("binary").alias("t"))
    texts = docs.select(F.col(text_col).cast("binary"))
    result = docs.withColumn(into, F.lit(None).cast(FOUND))
    shared, k = Shared(docs.sparkSession, "leaks"), 0
    block: list = []

    def scan(block: list) -> None:
        nonlocal result, k
        if k:  # cut, so that one index at a time is held
            result = shared.write(result, str(k))
        result = _pass(result, _index(block, texts), text_col, into)
        k += 1

    # items come to the driver a partition at a time; a window that returns in another block does no harm
    pending: dict = defaultdict(set)
    for row in items.toLocalIterator():
        for w, ids in item_windows([(row["i"], None if row["t"] is None else bytes(row["t"]))], window).items():
            pending[w] |= ids
        if len(pending) >= most:
            block = list(pending.items())
            for start in range(0, len(block), most):
                scan(block[start : start + most])
            pending.clear()
    if pending or not k:
        scan(list(pending.items()))
    return result


def covered(spans: str):
    """Words in a column of merged spans."""
    return F.aggregate(F.transform(F.col(spans), lambda p, i: F.when(i % 2 == 0, -p).otherwise(p)), F.lit(0).cast("bigint"), lambda a, p: a + p)
