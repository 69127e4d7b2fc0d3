"""Files that arrive over time become graph nodes, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import frontends


def sources(files: DataFrame) -> DataFrame:
    """graph_id, path, language, source of whole text files (value, path)."""
    return files.select(F.xxhash64("path").alias("graph_id"), "path", frontends.language().alias("language"), F.col("value").alias("source"))


def follow(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Parses files as they appear in `folder` and appends their nodes to the Parquet table `target`.

    A batch is written to a folder of its own number, overwritten if the batch runs again, so a restart adds no copies.
    """
    stream = spark.readStream.format("text").option("wholetext", True).load(folder).withColumn("path", F.col("_metadata.file_path"))

    def put(batch: DataFrame, number: int) -> None:
        frontends.parse(sources(batch)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
