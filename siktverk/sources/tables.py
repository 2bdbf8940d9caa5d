"""Reading the named tables of a directory of parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str, *columns: str) -> DataFrame:
    """``directory/name.parquet`` (file or folder), pruned to ``columns`` if any are given."""
    df = spark.read.parquet(f"{directory}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """For stages bound by Python time: at least one partition a core.

    A scan of few small files has fewer partitions than the cluster has cores. Larger scans keep theirs, so
    nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
