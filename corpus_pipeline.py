"""Five stages over `documents`: quality rules, line deduplication, near-duplicates, decontamination, tokenising.

Each stage gets all that the one before kept. A stage defines its nulls, repeats and empty tables as its operator does;
besides, of rows that repeat a doc_id together with its text, near-duplicate removal keeps one. All stages but the last
keep all columns, whatever their names; the last gives ids and digests, without text, n_chars and further columns.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvagraph.llm import bpe, decontaminate, line_templates, near_dup, quality
from sylvagraph.llm.common import fresh, shared_dir, table
from sylvagraph.llm.queries import BPE_RANKS

#: Texts of at least this similarity, in hundredths, are near-duplicates here; op2_near_dup has a contract of its own.
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a base rule or a certified cutoff rejects go."""
    return quality.passed(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; all documents stay."""
    dropped = fresh(docs.columns, "_dropped")
    cut = line_templates.drop_templates(docs, into=dropped)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", F.when(F.size(dropped) > 0, length).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays."""
    kept = near_dup.near_duplicates(docs, percent=NEAR_PERCENT).filter("kept").select(F.col("doc_id").alias("kept")).distinct()
    held = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"))
    return held.join(kept, F.col("id").eqNullSafe(F.col("kept")), "left_semi").dropDuplicates(["id", "key"]).select("doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    leaks = fresh(docs.columns, "_leaks")
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), into=leaks)
    return found.filter(F.size(f"{leaks}.spans") == 0).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids, and digests of the ids and of the text decoded from them."""
    ranks = public_tokenizers.path(BPE_RANKS)
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN, keep_text=False)
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return bpe.decode(encoded, ranks).select(
        "doc_id",
        "lang",
        "source",
        F.size("token_ids").cast("bigint").alias("n_tokens"),
        "token_ids",
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("byte-level BPE", tokenise),
]
#: Near-duplicate components, certified cutoffs and BPE can't be put in SQL; tests hold a run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written to the shared folder and read again."""
    docs, root = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
    return docs
