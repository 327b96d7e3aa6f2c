"""Page items as a stream: re-delivered items are dropped as they come, counts per artwork follow event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.functions import text as tx


def read_items(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """New page-item files of a folder, with the schema of those already there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_deliveries(items: DataFrame, late: str = "60 days") -> DataFrame:
    """Each item once, the first delivery to arrive; state older than the watermark is let go, so late repeats beyond it
    come through again."""
    timed = items.withColumn("loaded", F.col("loaded_at").cast("timestamp")).withWatermark("loaded", late)
    return timed.dropDuplicatesWithinWatermark(["doc_id", "page_no", "item_no"]).withColumn("text_norm", tx.normalize(F.col("text")))


def daily_counts(items: DataFrame, late: str = "60 days") -> DataFrame:
    """Items per artwork and day of loading."""
    timed = items.withColumn("loaded", F.col("loaded_at").cast("timestamp")).withWatermark("loaded", late)
    counted = timed.groupBy("doc_id", F.window("loaded", "1 day").alias("w")).agg(F.count("*").alias("n_items"))
    return counted.select("doc_id", F.col("w.start").alias("day"), "n_items")
