"""Streaming intake of answers: one row a rater and pair, late rows within a watermark, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siktverk.sources.readers import RESPONSES


def read_responses(spark: SparkSession, folder: str, files_per_trigger: int = 10) -> DataFrame:
    """Stream of parquet files with the response schema and an event time ``at``."""
    rows = spark.readStream.schema(RESPONSES).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.withColumn("at", F.col("submitted_at").try_cast("timestamp"))


def first_answers(rows: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first answer of each rater to each pair; state older than the delay is dropped."""
    return rows.withWatermark("at", delay).dropDuplicatesWithinWatermark(["rater_name", "pair_id"])


def hourly(rows: DataFrame, delay: str = "1 hour") -> DataFrame:
    """``hour, rater_name, answers, skipped`` by event time."""
    w = F.window("at", "1 hour")
    return rows.withWatermark("at", delay).groupBy(w, "rater_name").agg(F.count("*").alias("answers"), F.sum("skipped").alias("skipped")).select(F.col("window.start").alias("hour"), "rater_name", "answers", "skipped")


def run_to(rows: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Everything there is now, exactly once, to parquet."""
    rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(target).awaitTermination()
