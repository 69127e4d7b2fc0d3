"""Token counts behind a digest cache.

Every text is known by the digest of its normalised content (UTF-8 bytes, null as empty; the tokenizer's own
normaliser stays in the tokenizer). Digests are joined to the cache, Parquet tables of (content digest, n_tokens) below
a folder for each tokenizer's digest, in the shared folder or at a given path; only distinct misses are encoded and
appended. Each run appends a folder of its own, so runs side by side don't disturb each other, and a run that fails
leaves nothing that is read; a digest that two runs have counted is taken once.

Within a worker, the text is cut where no merge can reach across: before a run of space marks, if no piece of the
vocabulary has a space mark after another character, and at line ends, if no piece holds one. The counts of such
segments are remembered. A vocabulary without these properties is used on whole texts.

Defined cases: null and empty texts have 0 bytes and the count that the library gives for the empty text; repeated
rows give a row each and are encoded once; an empty table appends no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_by, rows_of, shared_dir, text_bytes, tune

MOST_SEGMENTS = 400_000
SPACE_MARK = "▁"


class Counter(dict):
    """Counts tokens as sentencepiece does; segment -> count."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        plain = [p for i, p in enumerate(pieces) if not self.model.is_byte(i) and not self.model.is_control(i) and not self.model.is_unknown(i)]
        probe = "a  b\nＡ  \tﬁ "
        self.splits = not any(SPACE_MARK in p.lstrip(SPACE_MARK) or "\n" in p for p in plain) and self.model.normalize(probe) == (SPACE_MARK + probe).replace(" ", SPACE_MARK)
        # marks that the library may match before merging would make cuts unsafe
        self.splits = self.splits and all(self._count(f"x{p}") == self._count("x" + p) for p in ("<s>", "</s>"))
        self.line_end = self._count("\n") - 1 if self.splits else 0
        self.segments = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+")

    def _count(self, text: str) -> int:
        return len(self.model.encode(text, num_threads=1))

    def __missing__(self, segment: str) -> int:
        # the library puts one space mark before what it gets; a line end keeps it apart from what has none
        # but it gives nothing for the empty text
        if segment == SPACE_MARK:
            n = self._count("\n") - self.line_end
        elif segment[0] == SPACE_MARK:
            n = self._count(segment[1:])
        else:
            n = self._count("\n" + segment) - 1 - self.line_end
        if len(segment) <= 64:
            if len(self) >= MOST_SEGMENTS:
                self.clear()
            self[segment] = n
        return n

    def count(self, text: str) -> int:
        if not self.splits or not text:
            return self._count(text)
        lines = (SPACE_MARK + text.replace(" ", SPACE_MARK)).split("\n")
        n = (len(lines) - 1) * self.line_end
        for line in lines:
            n += sum(map(self.__getitem__, self.segments.findall(line)))
        return n


_COUNTERS: dict[str, Counter] = {}


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def content_digest(text_col: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))


def _once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes each text of a task on once, so that a hot text is shuffled once from each task."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for d in batch.column(0).to_pylist():
            short = d[:12]
            keep.append(short not in seen)
            if len(seen) < 2_000_000:
                seen.add(short)
        yield batch.filter(pa.array(keep, pa.bool_()))


def count_misses(misses: DataFrame, path: str) -> DataFrame:
    """(digest, text bytes), all rows of a digest in one partition -> (digest, n_tokens), each digest once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(path)
        counter, last = _COUNTERS[path], None

        def rows() -> Iterator[tuple]:
            nonlocal last
            for digest, data in rows_of(batches):
                if digest != last:
                    last = digest
                    yield digest, counter.count((data or b"").decode("utf-8", "replace"))

        yield from batches_by(rows(), pa.schema([("digest", pa.binary()), ("n_tokens", pa.int64())]))

    return misses.sortWithinPartitions("digest").mapInArrow(run, "digest binary, n_tokens bigint")


def count_tokens(docs: DataFrame, path: str, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and n_tokens of every row; appends what the cache lacked."""
    spark = docs.sparkSession
    tune(spark)
    folder = f"{cache_path or shared_dir(spark) + '/token-cache'}/{tokenizer_digest(path)}"
    schema = "digest binary, n_tokens bigint"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())

    def cache() -> DataFrame:
        return spark.read.schema(schema).parquet(f"{folder}/*").groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))

    texts = docs.select(content_digest(text_col).alias("digest"), F.coalesce(text_bytes(text_col), F.lit(b"")).alias("data"))
    texts = texts.mapInArrow(_once, texts.schema)
    misses = texts.join(cache(), "digest", "left_anti") if fs.exists(fs_path) else texts
    count_misses(misses.repartition("digest"), path).write.parquet(f"{folder}/{uuid.uuid4().hex}")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("bigint").alias("n_bytes"), content_digest(text_col).alias("digest"))
    return rows.join(cache(), "digest").select("doc_id", "n_bytes", "n_tokens")
