"""What the operators share: the shared folder, cut lineage, words and hashes."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of one white-space character of the contracts: 0x20 and 0x09-0x0D.
SPACE = r"[ \x09-\x0D]"
#: Java pattern of one word character of the contracts.
NOT_SPACE = r"[^ \x09-\x0D]"
#: Entries of a worker's word-hash memo; the memo is emptied when it is full.
MEMO_WORDS = 250_000

_MASK = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or an own one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sylvagraph-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def tune(spark: SparkSession) -> None:
    """Settings of the operators: small Arrow batches, as texts are long and Python holds a batch several times over;
    no partition-aware unions, which can go wrong together with exchange reuse."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


class Shared:
    """Tables written to the shared folder to cut lineage; `drop` removes one that is no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        df.write.mode("overwrite").option("compression", compression).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def release(self) -> None:
        """Lets Spark remove the shuffle files of finished jobs now: it does so when the driver collects garbage, and
        what Python held is garbage to the driver a moment later."""
        gc.collect()
        self.spark.range(1).collect()  # the listeners' queue holds on to the last query until there is another one
        for _ in range(2):
            self.spark._jvm.System.gc()
            time.sleep(0.3)

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: Iterable[str], name: str) -> str:
    """A column name like `name` that no column has, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(column: str) -> Column:
    """A text column as UTF-8 bytes; null stays null."""
    return F.col(column).cast("binary")


class WordHash(dict):
    """word bytes -> 64-bit hash, remembered up to MEMO_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_SPACES = np.zeros(256, bool)
_SPACES[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
#: A random number for each byte at each place in a word, modulo 64; white space counts nothing.
_AT = np.random.default_rng(64).integers(0, 1 << 63, (256, 64), np.uint64) * np.uint64(2) + np.uint64(1)
_AT[_SPACES] = 0
_FOLDED = _AT.copy()
_FOLDED[65:91] = _AT[97:123]
#: Bytes that are hashed at once; a single longer word is, too.
HASH_BLOCK = 1 << 20


def _hash_block(data: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b = np.frombuffer(data, np.uint8)
    word = ~_SPACES[b]
    edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    own = np.zeros(len(b), np.int32)  # start of the word that a byte belongs to or follows
    own[starts] = np.diff(starts, prepend=0)
    at = np.arange(len(b), dtype=np.int32) - np.cumsum(own, dtype=np.int32)
    value = table.ravel()[(b.astype(np.int32) << 6) | (at & 63)]
    sizes = ends - starts
    if int(sizes.max()) > 64:
        value *= 2 * (at >> 6).astype(np.uint64) + np.uint64(1)
    return mix(np.add.reduceat(value, starts) + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), starts, ends


def hashed_words(texts: Iterable[bytes | None], fold: bool = False) -> Iterator[np.ndarray]:
    """64-bit hashes of the white-space separated words of each text, in turn; with `fold`, A-Z count as a-z.

    Texts are hashed together, about HASH_BLOCK bytes at a time; long texts are cut between words.
    """
    table = _FOLDED if fold else _AT
    held: list[bytes] = []
    size = 0

    def together() -> Iterator[np.ndarray]:
        hashes, starts, _ = _hash_block(b" ".join(held) + b" ", table)
        ends = np.cumsum([len(x) + 1 for x in held])
        yield from np.split(hashes, np.searchsorted(starts, ends[:-1]))

    for text in texts:
        text = text or b""
        if len(text) > HASH_BLOCK:
            if held:
                yield from together()
                held, size = [], 0
            yield np.concatenate([_hash_block(part, table)[0] for part in cut_between_words(text)])
            continue
        held.append(text)
        size += len(text) + 1
        if size >= HASH_BLOCK:
            yield from together()
            held, size = [], 0
    if held:
        yield from together()


def cut_between_words(text: bytes) -> Iterator[bytes]:
    """Parts of about HASH_BLOCK bytes that each end after a whole word."""
    start = 0
    while start < len(text):
        end = start + HASH_BLOCK
        while end < len(text) and not _SPACES[text[end]]:
            end += 1
        yield text[start:end]
        start = end


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def window_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """64-bit hashes of all runs of `size` consecutive word hashes; empty if there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64((seed * 0x9E3779B97F4A7C15 + size) & _MASK))
    for k in range(size):
        out = out * np.uint64(0x9E3779B185EBCA87) + words[k : k + n]
        out ^= out >> np.uint64(29)
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as the int64 of the same bits, for a Spark bigint column."""
    return np.ascontiguousarray(x).view(np.int64)


def batches_by(rows: Iterable[tuple], schema: pa.Schema, size: Iterable[int] | None = None, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as record batches; a batch ends when its cells hold about `most` bytes."""
    cells: list[list] = [[] for _ in schema]
    held = 0
    for row in rows:
        for cell, value in zip(cells, row, strict=True):
            cell.append(value)
            held += len(value) if isinstance(value, (bytes, str)) else 16
        if held >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, schema, strict=True)], schema=schema)
            cells, held = [[] for _ in schema], 0
    if cells and cells[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, schema, strict=True)], schema=schema)


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Row tuples, 512 rows at a time, so that few long texts are held as Python objects at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)
