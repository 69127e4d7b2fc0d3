"""Repeated passages: substring deduplication by winnowed anchors, and by sparse suffix arrays.

Both find every run of `length` words that also starts in a document with a smaller id, exactly but for equal 64-bit
hashes of different windows, in three steps:

1. Anchors. Of every window of `length` words, the k-gram of least hash is kept (winnowing, minimisers). Equal windows
   keep the same k-gram, so documents that share a window share an anchor.
   `substring`: documents are joined on the anchors' hashes.
   `suffix`: the suffixes that start at the anchors are sorted by their first k words, over ranges of these words, and
   each is compared with its neighbours; those that begin like a suffix of another document go on.
2. Extension. Around each shared anchor, to the left and to the right, the windows that have chosen it are compared as
   wholes, by hash; a window that has a copy in a document with a smaller id is repeated. Overlapping and adjacent
   windows make the maximal repeats.
3. The words of repeats are taken out.

A batch of rows settles what it can by itself: of rows with one key, only one, or those of its smallest document, are
dealt out by key; the others are known already and dealt out evenly. So a passage that stands in a third of all
documents brings a row per batch to a task, and no pairs are ever made.

Defined cases: null, empty and short texts have no windows and lose nothing; a null doc_id counts as larger than any
other and null ids don't count as smaller than each other; rows of one id are never smaller than each other, and each
is judged by its own text (rows are known by id and a 64-bit hash of id and text); ids must be whole numbers, others
raise TypeError; other columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shared, batches_by, hashed_words, rows_of, signed, text_bytes, tune, window_hashes
from .near_dup import MAP_BITS

SUBSTRING_LENGTH, SUBSTRING_GRAM = 13, 7
SUFFIX_LENGTH, SUFFIX_GRAM = 50, 8
#: Text bytes whose rows one task of a shuffle takes.
TASK_BYTES = 48 << 20
LAST_ID = (1 << 63) - 1

_LOW = np.uint64((1 << 24) - 1)


def minimisers(hashes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """k-gram hashes, and for each window of `length` words the place of its least k-gram, the first of equals."""
    grams = window_hashes(hashes, gram)
    n = len(hashes) - length + 1
    if n <= 0:
        return grams, np.empty(0, np.int64)
    low = (grams & ~_LOW) | (np.arange(len(grams), dtype=np.uint64) & _LOW)
    width, have = length - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    at = np.arange(n, dtype=np.int64)
    return grams, at + (((low[:n] & _LOW).astype(np.int64) - at) & int(_LOW))


def _distinct(sorted_places: np.ndarray) -> np.ndarray:
    return sorted_places[np.flatnonzero(np.diff(sorted_places, prepend=-1))] if len(sorted_places) else sorted_places


_ROWS = "hash bigint, doc bigint, row bigint, at int, known boolean, part bigint"


def _settled(hash_: np.ndarray, doc: np.ndarray, at: np.ndarray, least: bool, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash and document; per ordered row, whether it is found out, and whether it must go on by hash.

    least: found out is what has its hash in a smaller document; else, what has it in another one.
    """
    order = np.lexsort((at, doc, hash_))
    h, d = hash_[order], doc[order]
    if not len(h):
        return order, np.empty(0, bool), np.empty(0, bool)
    starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    sizes = np.diff(np.append(starts, len(h)))
    low = np.repeat(np.minimum.reduceat(d, starts), sizes)
    if least:
        return order, d > low, d == low
    several = np.repeat(np.maximum.reduceat(d, starts), sizes) > low
    if known is not None:
        several |= np.repeat(np.logical_or.reduceat(known[order], starts), sizes)
    first = np.zeros(len(h), bool)
    first[starts] = True
    return order, several, ~several | first


def _dealt(parts: list[tuple], least: bool) -> pa.RecordBatch:
    """The rows of a batch of documents: what is known is dealt out evenly, what isn't by hash."""
    hash_, doc, row, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    order, known, on = _settled(hash_, doc, at, least)
    hash_, doc, row, at = hash_[order], doc[order], row[order], at[order]
    rest = known & ~on
    out = [(hash_[on], doc[on], row[on], at[on], known[on], hash_[on]), (hash_[rest] & 0, doc[rest], row[rest], at[rest], known[rest], row[rest] + at[rest])]
    columns = [np.concatenate(x) for x in zip(*out, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns[:3]] + [pa.array(columns[3].astype(np.int32))] + [pa.array(c) for c in columns[4:]], names=["hash", "doc", "row", "at", "known", "part"])


_FOUND = "doc bigint, row bigint, at int"


def _found_out(rows: DataFrame, parts: int, least: bool) -> DataFrame:
    """doc, row, at of the rows found out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches), None) if (batches := list(batches)) else None
        if got is None or not got.num_rows:
            return
        hash_, doc, row, at, known = (got.column(c).to_numpy() for c in ("hash", "doc", "row", "at", "known"))
        # in the anchors' step a row on by hash may be known and tell the others; else known rows are done
        by_hash = ~known if least else (hash_ != 0) | ~known
        yes = known.copy()
        if by_hash.any():
            own = np.flatnonzero(by_hash)
            order, several, _ = _settled(hash_[own], doc[own], at[own], least, None if least else known[own])
            yes[own[order[several]]] = True
        yield pa.RecordBatch.from_arrays([pa.array(doc[yes]), pa.array(row[yes]), pa.array(at[yes])], names=["doc", "row", "at"])

    return rows.repartition(parts, "part").mapInArrow(run, _FOUND)


def _by_row(found: DataFrame) -> DataFrame:
    """doc, row, places: at most a text's words."""
    return found.groupBy("doc", "row").agg(F.collect_set("at").alias("places"))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple]:
    """doc, row, text, word hashes; 512 texts are held at once."""
    for start in range(0, batch.num_rows, 512):
        part = batch.slice(start, 512)
        data = part.column("data").to_pylist()
        yield from zip(part.column("doc").to_pylist(), part.column("row").to_pylist(), data, hashed_words(data), strict=True)


def _anchored(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """A row for each distinct anchor, by the hash of its k-gram."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for doc, row, _, hashes in _texts(batch):
                if len(hashes) >= length:
                    grams, at = minimisers(hashes, length, gram)
                    at = _distinct(at)
                    parts.append((signed(grams[at]), np.full(len(at), doc), np.full(len(at), row), at))
            if parts:
                yield _dealt(parts, False)

    return docs.mapInArrow(run, _ROWS)


_SUFFIX = "suffix binary, doc bigint, row bigint, at int, known boolean, on boolean"


def _suffixes(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """The suffixes at the anchors by their first words. Of those that a batch of documents has in common, one goes on to
    be sorted; all are known to be shared."""
    schema = pa.schema([("suffix", pa.binary()), ("doc", pa.int64()), ("row", pa.int64()), ("at", pa.int32()), ("known", pa.bool_()), ("on", pa.bool_())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            suffixes, rows, firsts, shared = [], [], {}, set()
            for doc, row, data, hashes in _texts(batch):
                if len(hashes) < length:
                    continue
                words = data.split()
                for p in _distinct(minimisers(hashes, length, gram)[1]).tolist():
                    suffix = b" ".join(words[p : p + gram])
                    if firsts.setdefault(suffix, doc) != doc:
                        shared.add(suffix)
                    suffixes.append(suffix)
                    rows.append((doc, row, p))
            if not rows:
                continue
            known = [x in shared for x in suffixes]
            on = [not k or x in shared and (shared.discard(x) or True) for x, k in zip(suffixes, known, strict=True)]
            doc, row, at = zip(*rows, strict=True)
            text = [x if o else None for x, o in zip(suffixes, on, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((text, doc, row, at, known, on), schema, strict=True)], schema=schema)

    return docs.mapInArrow(run, _SUFFIX)


def _neighbours(suffixes: DataFrame, parts: int) -> DataFrame:
    """doc, row, at of the suffixes that begin like one of another document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, low, several, held = None, 0, False, []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            doc, row, at = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(at, pa.int32())], names=["doc", "row", "at"])

        for batch in batches:
            found = []
            for suffix, doc, row, at, known in zip(*(batch.column(c).to_pylist() for c in ("suffix", "doc", "row", "at", "known")), strict=True):
                if suffix != before:
                    before, low, several, held = suffix, doc, False, []
                several = several or known or doc != low
                if several:
                    found += [*held, (doc, row, at)]
                    held = []
                else:
                    held.append((doc, row, at))  # of one document, as rows are sorted by it
            if found:
                yield out(found)

    ordered = suffixes.filter("on").repartitionByRange(parts, "suffix").sortWithinPartitions("suffix", "doc")
    return ordered.select("suffix", "doc", "row", "at", "known").mapInArrow(run, _FOUND).unionByName(suffixes.filter("NOT on").select("doc", "row", "at"))


def _windowed(docs: DataFrame, places: DataFrame, length: int, gram: int) -> DataFrame:
    """A row for each window whose anchor is shared."""
    joined = docs.join(places, ["doc", "row"]).select("doc", "row", "data", "places")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for (doc, row, _, hashes), own in zip(_texts(batch), batch.column("places"), strict=True):
                if len(hashes) < length:
                    continue
                shared = np.zeros(len(hashes), bool)
                shared[own.values.to_numpy()] = True
                start = np.flatnonzero(shared[minimisers(hashes, length, gram)[1]])
                if len(start):
                    parts.append((signed(window_hashes(hashes, length)[start]), np.full(len(start), doc), np.full(len(start), row), start))
            if parts:
                yield _dealt(parts, True)

    return joined.mapInArrow(run, _ROWS)


def _spot() -> Column:
    return F.pmod(F.xxhash64("doc", "row"), F.lit(1 << MAP_BITS)).cast("bigint")


def _split_by(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents that are among `ids` (doc, row), with a few others, and the rest; ids are held in a map of fixed size."""
    found = ids.select(_spot().alias("k")).groupBy(F.expr("int(k div 32)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(pmod(k, 32)))")).alias("bits")).toArrow()
    bits = np.zeros(1 << MAP_BITS - 5, np.uint32)  # at most so many rows
    bits[found["w"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    def half(inside: bool) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.frombuffer(shared.value, np.uint32)
            for batch in batches:
                k = batch.column("_spot").to_numpy()
                hit = (own[k >> 5] >> (k & 31).astype(np.uint32) & 1).astype(bool)
                yield batch.drop_columns("_spot").filter(pa.array(hit == inside))

        return docs.withColumn("_spot", _spot()).mapInArrow(run, docs.schema)

    return half(True), half(False)


def _taken_out(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, n_words, removed (start, end, ...), kept text; `places` are the starts of repeated windows."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("doc_id", batch.schema.field(0).type), ("n_words", pa.int64()), ("removed", pa.list_(pa.int64())), ("kept", pa.string())])

            def rows(batch: pa.RecordBatch = batch) -> Iterator[tuple]:
                for doc, data, places in rows_of([batch]):
                    words = (data or b"").split()
                    spans: list[int] = []
                    for p in sorted(places or ()):
                        if spans and p <= spans[-1]:
                            spans[-1] = p + length
                        else:
                            spans += (p, p + length)
                    kept, last = [], 0
                    for start, end in zip(spans[::2], spans[1::2], strict=True):
                        kept += words[last:start]
                        last = end
                    kept += words[last:]
                    yield doc, len(words), spans, b" ".join(kept).decode("utf-8", "replace")

            yield from batches_by(rows(), schema)

    return docs.mapInArrow(run, f"doc_id {id_type}, n_words bigint, removed array<bigint>, kept string")


def _repeats(documents: DataFrame, id_col: str, text_col: str, length: int, gram: int, sort: bool) -> DataFrame:
    spark = documents.sparkSession
    tune(spark)
    shared = Shared(spark, "repeats")
    kind = documents.schema[id_col].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"ids must be whole numbers, not {kind.simpleString()}")
    docs = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST_ID)).alias("doc"), F.xxhash64(id_col, text_col).alias("row"), text_bytes(text_col).alias("data"))
    total = docs.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / TASK_BYTES))
    bare = docs.select("doc", "row", "data")
    if sort:
        found = _neighbours(shared.write(_suffixes(bare, length, gram), "suffixes"), parts)
    else:
        found = _found_out(_anchored(bare, length, gram), parts, False)
    anchors = shared.write(_by_row(found), "anchors")
    del found
    shared.drop("suffixes")
    shared.release()
    near, _ = _split_by(bare, anchors)
    repeats = shared.write(_by_row(_found_out(_windowed(near, anchors, length, gram), parts, True)), "repeats")
    del near
    shared.drop("anchors")
    shared.release()
    touched, rest = _split_by(docs, repeats)
    touched = touched.join(repeats, ["doc", "row"], "left").select("doc_id", "data", "places")
    return _taken_out(touched, length).unionByName(_taken_out(rest.select("doc_id", "data", F.lit(None).cast("array<int>").alias("places")), length))


def substring(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = SUBSTRING_LENGTH, gram: int = SUBSTRING_GRAM) -> DataFrame:
    """doc_id, n_words, removed (start, end, start, ...), kept: substring deduplication by seed and extension."""
    return _repeats(documents, id_col, text_col, length, gram, False)


def suffix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = SUFFIX_LENGTH, gram: int = SUFFIX_GRAM) -> DataFrame:
    """The same by a sparse suffix array, for longer passages."""
    return _repeats(documents, id_col, text_col, length, gram, True)


def removed_words(spans: str) -> Column:
    return F.aggregate(F.transform(F.col(spans), lambda p, i: F.when(i % 2 == 0, -p).otherwise(p)), F.lit(0).cast("bigint"), lambda a, p: a + p)
