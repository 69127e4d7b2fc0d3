"""Near-duplicate documents: MinHash, banding, verification, connected components.

1. Each text gives its set of 5-word shingles, a digest of that set, and MINIMA minima of universal hashes of it. Texts
   of equal sets form a class; from here on one row stands for a class, so copies cost nothing.
2. Classes meet in 2 * MINIMA / r buckets, each keyed by r of the minima (every minimum serves in two bands). Within a bucket
   each class is compared with one hub only: the member that fills the largest buckets over all bands, as the original
   of a group of edited copies does. A bucket of any size gives as many pairs as it has members.
3. Pairs pass a length bound, then their signatures' agreement, then the Jaccard index of the full sets decides.
4. Components of the confirmed links. Buckets that still hold several components may hide links that don't touch a hub.
   In those of up to SMALL rows all pairs across components are compared. Larger ones are groups of copies that are
   almost, but not quite, all linked: buckets that share members make a group, and the group's members outside its
   largest component are held against all its members on full sets, block by block; a task gets two blocks, and only
   one link from a text to a component leaves it.
5. Final components; the least doc_id of a component names it.

r is the largest with which all bands of a pair at the least similarity miss with MOST_MISSED or less, were they
independent; as minima are shared, the figures are some times higher. With J = 0.85, r is 7: a band meets with 0.85^7 =
0.32, all 48 miss with 9e-9. With J = 0.80, r is 6: a band meets with 0.80^6 = 0.26, all 56 miss with 4e-8.

Defined cases: null, empty or word-less texts have no shingles, are linked with nothing and kept; texts of fewer words
than a shingle have the whole sequence as their only one; repeated rows give a row each, in one class; a null doc_id
takes part like any other but never names a component that has another id; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, batches_by, hashed_words, rows_of, signed, text_bytes, tune, window_hashes
from .components import components

SHINGLE = 5
MINIMA = 168
#: Links need 100 * intersection >= percent * union; this is the contract's percent.
PERCENT = 85
MOST_MISSED = 1e-7
#: Signatures that agree less than the least similarity by more than so many standard deviations are dropped.
DEVIATIONS = 5.44
SMALL = 24
#: Texts in a block of the members outside a group's largest component, and of all its members.
OUTSIDE_BLOCK, BLOCK = 256, 512
#: Bits of the map of documents that verification reads; fixed, so it never grows with the corpus.
MAP_BITS = 25

_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 63, MINIMA, np.uint64) << np.uint64(1) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, MINIMA, np.uint64)
#: Which minima the bands read in turn: every minimum once in the first half of the bands, once in the second.
_BAND_ORDER = np.concatenate([np.arange(MINIMA), _rng.permutation(MINIMA)])


def band_rows(percent: int) -> np.ndarray:
    """The minima that each band reads, a row for each band."""
    fits = [r for r in range(1, MINIMA + 1) if MINIMA % r == 0 and (1 - (percent / 100) ** r) ** (2 * MINIMA // r) <= MOST_MISSED]
    return _BAND_ORDER.reshape(-1, max(fits, default=1))


def least_agreement(percent: int) -> float:
    """0.700 for 85, 0.632 for 80."""
    j = percent / 100
    return j - DEVIATIONS * math.sqrt(j * (1 - j) / MINIMA)


def shingles_of(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text's word hashes."""
    if not len(words):
        return np.empty(0, np.uint64)
    hashes = np.sort(window_hashes(words, min(size, len(words))))
    return hashes[np.concatenate(([True], hashes[1:] != hashes[:-1]))]


def shingle_set(data: bytes | None, size: int = SHINGLE) -> np.ndarray:
    return shingles_of(next(hashed_words([data], True)), size)


def set_digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of a*x + b mod 2^64, the upper halves of which are universal hashes of the shingles' upper halves."""
    low = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    x = shingles >> np.uint64(32)
    for start in range(0, len(x), 128):
        h = np.multiply.outer(_A, x[start : start + 128])
        h += _B[:, None]
        np.minimum(low, h.min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_shingles, cls, signature; a signature only for the first row of a class in a task."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            schema = pa.schema([("doc_id", batch.schema.field(0).type), ("key", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.binary()), ("signature", pa.binary())])

            def rows(batch: pa.RecordBatch = batch) -> Iterator[tuple]:
                keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for (doc, key), words in zip(keys, hashed_words((x.as_py() for x in batch.column(2)), True), strict=True):
                    s = shingles_of(words)
                    if not len(s):
                        yield doc, key, 0, None, None
                        continue
                    cls = set_digest(s)
                    new = cls not in seen
                    if new and len(seen) < 1_000_000:
                        seen.add(cls)
                    yield doc, key, len(s), cls, signature(s).tobytes() if new else None

            yield from batches_by(rows(), schema)

    return docs.mapInArrow(run, f"doc_id {id_type}, key bigint, n_shingles bigint, cls binary, signature binary")


def _banded(classes: DataFrame, percent: int) -> DataFrame:
    """bucket, cls, n for every band of every class."""
    read = band_rows(percent)
    bands, size = read.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, MINIMA)
                key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.zeros((len(sig), 1), np.uint64)
                for r in range(size):
                    key = (key ^ sig[:, read[:, r]]) * np.uint64(0xFF51AFD7ED558CCD)
                    key ^= key >> np.uint64(32)
                at = pa.array(np.repeat(np.arange(len(sig)), bands))
                yield pa.RecordBatch.from_arrays([pa.array(signed(key.ravel())), batch.column("cls").take(at), batch.column("n").take(at)], names=["bucket", "cls", "n"])

    return classes.select("cls", "n", "signature").mapInArrow(run, "bucket bigint, cls binary, n bigint")


def _near(a: str, b: str, percent: int):
    """The length bound of the similarity."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _agreeing(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose signatures agree well enough, with a row (doc, key) of each."""
    left = classes.select(F.col("cls").alias("a"), F.struct("doc", "key").alias("a_row"), F.col("signature").alias("a_sig"))
    right = classes.select(F.col("cls").alias("b"), F.struct("doc", "key").alias("b_row"), F.col("signature").alias("b_sig"))
    least = least_agreement(percent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, MINIMA) for c in ("a_sig", "b_sig"))
                good = (x == y).mean(axis=1) >= least
                yield batch.select(["a", "b", "a_row", "b_row"]).filter(pa.array(good))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "a_row", "b_row", "a_sig", "b_sig")
    return joined.mapInArrow(run, joined.drop("a_sig", "b_sig").schema)


def _some(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents that are among `rows` (doc, key), and a few others: rows are held as one bit each in a map of fixed
    size. Of rows without an id one of each text is enough."""
    def spot(doc: str):
        return F.pmod(F.xxhash64(doc, "key"), F.lit(1 << MAP_BITS)).cast("bigint")

    words = rows.select(spot("doc").alias("k")).groupBy((F.col("k") / 32).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(pmod(k, 32)))")).alias("bits"))
    found = words.toArrow()  # at most 2^MAP_BITS / 32 rows
    bits = np.zeros(1 << MAP_BITS - 5, np.uint32)
    bits[found["w"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.frombuffer(shared.value, np.uint32)
        for batch in batches:
            k = batch.column("_spot").to_numpy()
            yield batch.drop_columns("_spot").filter(pa.array((own[k >> 5] >> (k & 31).astype(np.uint32) & 1).astype(bool)))

    found = docs.withColumn("_spot", spot("doc_id")).mapInArrow(run, docs.schema)
    nameless = found.filter("doc_id IS NULL").groupBy("key").agg(F.first("data").alias("data")).select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "key", "data")
    return found.filter("doc_id IS NOT NULL").unionByName(nameless)


def _is(row: str):
    """The condition that a text (doc_id, key) is a row (doc, key)."""
    return F.col("doc_id").eqNullSafe(F.col(f"{row}.doc")) & (F.col("key") == F.col(f"{row}.key"))


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of classes whose full sets are similar."""
    texts = _some(docs, pairs.select("a_row.*").unionByName(pairs.select("b_row.*")))
    joined = pairs.join(texts, _is("b_row")).select("a", "b", "a_row", F.col("data").alias("b_data"))
    joined = joined.join(texts, _is("a_row")).select("a", "b", F.col("data").alias("a_data"), "b_data")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[bytes, np.ndarray] = OrderedDict()

        def of(cls: bytes, data: bytes) -> np.ndarray:
            if cls in held:
                held.move_to_end(cls)
                return held[cls]
            s = shingle_set(data)
            if set_digest(s) != cls:
                return s[:0]
            held[cls] = s
            if len(held) > 256:
                held.popitem(last=False)
            return s

        def rows() -> Iterator[tuple]:
            for a, b, a_data, b_data in rows_of(batches):
                x, y = of(a, a_data), of(b, b_data)
                if len(x) and len(y):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        yield a, b

        yield from batches_by(rows(), pa.schema([("u", pa.binary()), ("v", pa.binary())]))

    return joined.mapInArrow(run, "u binary, v binary")


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket of `rows` (bucket, cls, n, comp)."""
    one, other = (rows.select("bucket", F.col("cls").alias(c), F.col("n").alias(f"{c}_n"), F.col("comp").alias(f"{c}_comp")) for c in ("a", "b"))
    pairs = one.join(other, "bucket").filter((F.col("a") < F.col("b")) & (F.col("a_comp") != F.col("b_comp")) & _near("a_n", "b_n", percent))
    return pairs.select("a", "b").distinct()


def _within_groups(rows: DataFrame, classes: DataFrame, docs: DataFrame, shared: Shared, percent: int) -> DataFrame:
    """Links (u, v) across components within groups of buckets that share members."""
    least = rows.groupBy("bucket").agg(F.min("cls").alias("u"))
    groups = components(rows.select("bucket", F.col("cls").alias("v")).join(least, "bucket").select("u", "v"))
    placed = rows.select("cls", "comp").distinct().join(groups.select(F.col("node").alias("cls"), F.col("root").alias("grp")), "cls")
    by_comp = placed.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("size"))
    main = by_comp.groupBy("grp").agg(F.max(F.struct("size", "comp")).alias("m"), F.sum("size").alias("all"))
    grid = main.select("grp", F.col("m.comp").alias("main"), F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("all") - F.col("m.size")) / OUTSIDE_BLOCK).cast("int").alias("outside_blocks"))
    placed = shared.write(placed.join(grid, "grp").join(classes.select("cls", F.struct("doc", "key").alias("row")), "cls"), "placed")
    spot = F.xxhash64("cls")
    with_text = placed.join(_some(docs, placed.select("row.*")), _is("row")).withColumns({"_block": F.pmod(spot, F.col("blocks")).cast("int"), "_outside": F.pmod(spot, F.col("outside_blocks")).cast("int")})
    all_ = with_text.select("grp", "_block", F.explode(F.sequence(F.lit(0), F.col("outside_blocks") - 1)).alias("_outside"), F.lit(False).alias("asks"), "cls", "comp", "data")
    outside = with_text.filter(F.col("comp") != F.col("main")).select("grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_block"), "_outside", F.lit(True).alias("asks"), "cls", "comp", "data")

    def run(table: pa.Table) -> pa.Table:
        asks, cls, comp, data = (table.column(c).to_pylist() for c in ("asks", "cls", "comp", "data"))
        sets = [shingle_set(x) for x in data]
        sets = [x if set_digest(x) == c else x[:0] for x, c in zip(sets, cls, strict=True)]
        told = [k for k, q in enumerate(asks) if not q and len(sets[k])]
        found: list[tuple[bytes, bytes]] = []
        if told:
            sizes = np.array([len(sets[k]) for k in told])
            values, places = np.unique(np.concatenate([sets[k] for k in told]), return_inverse=True)
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            for k, q in enumerate(asks):
                x = sets[k]
                if not q or not len(x):
                    continue
                at = np.searchsorted(values, x)
                at[at == len(values)] = 0
                own = np.zeros(len(values), bool)
                own[at[values[at] == x]] = True
                both = np.add.reduceat(own[places].astype(np.int64), starts)
                near = {comp[told[j]]: told[j] for j in np.flatnonzero(100 * both >= percent * (len(x) + sizes - both)) if comp[told[j]] != comp[k]}
                found += [(cls[k], cls[j]) for j in near.values()]
        return pa.table({"u": pa.array([a for a, _ in found], pa.binary()), "v": pa.array([b for _, b in found], pa.binary())})

    return all_.unionByName(outside).groupBy("grp", "_block", "_outside").applyInArrow(run, "u binary, v binary")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; texts are linked from a similarity of `percent` hundredths."""
    spark = documents.sparkSession
    tune(spark)
    shared = Shared(spark, "near-dup")
    docs = documents.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("key"), text_bytes(text_col).alias("data"))
    rows = shared.write(_signed(docs), "rows")
    classes = shared.write(rows.filter("cls is not null").groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc"), "key")).alias("r"), F.first("n_shingles").alias("n"), F.first("signature", ignorenulls=True).alias("signature")).select("cls", "r.doc", "r.key", "n", "signature"), "classes")
    banded = _banded(classes, percent)
    sizes = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = shared.write(banded.join(sizes, "bucket"), "members")

    weight = members.groupBy("cls").agg(F.sum("size").alias("weight"))
    weighted = members.join(weight, "cls").select("bucket", "cls", "n", "weight")
    hubs = weighted.groupBy("bucket").agg(F.max(F.struct("weight", "cls", "n")).alias("hub")).select("bucket", F.col("hub.cls").alias("hub"), F.col("hub.n").alias("hub_n"))
    spokes = members.join(hubs, "bucket").filter((F.col("cls") != F.col("hub")) & _near("n", "hub_n", percent))
    pairs = spokes.select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")).distinct()
    tried = shared.write(_agreeing(pairs, classes, percent), "tried")
    links = shared.write(_confirmed(tried, docs, percent), "links")

    first = shared.write(components(links), "first")
    placed = members.select("bucket", "cls", "n").join(first.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("comp", F.coalesce("root", "cls")).drop("root")
    open_ = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("bucket", "size")
    open_ = shared.write(placed.join(open_, "bucket"), "open")
    rest = _across(open_.filter(F.col("size") <= SMALL), percent).join(tried.select("a", "b"), ["a", "b"], "left_anti")
    also = shared.write(_agreeing(rest, classes, percent), "also")
    more = [shared.write(_confirmed(also, docs, percent), "more")] if not also.isEmpty() else []
    large = open_.filter(F.col("size") > SMALL)
    if not large.isEmpty():
        more.append(shared.write(_within_groups(large, classes, docs, shared, percent), "within"))
    if more:
        for x in more:
            links = links.unionByName(x)
        first = components(links)
    # the least id of each component, then of each class, then of each row
    at = classes.select("cls", "doc").join(first.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = shared.write(at.join(at.groupBy("root").agg(F.min("doc").alias("component_id")), "root").select("cls", "component_id"), "named")
    result = rows.select("doc_id", "n_shingles", "cls").join(named, "cls", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return result.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
