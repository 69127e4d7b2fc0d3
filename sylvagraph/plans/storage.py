"""Session settings, and tables that cut lineage in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Settings that the operators rely on. Edge sets are unions of parts of one plan, which the partition-aware union
    can get wrong together with exchange reuse; it is switched off."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or an own folder where it is unset."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sylvagraph-"))
    return context.getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows, written once and read back; survives the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
