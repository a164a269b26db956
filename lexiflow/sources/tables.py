"""Access to the driver tables (one parquet file per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def spread(df: DataFrame, min_parts: int | None = None) -> DataFrame:
    """Spread a scan that yields fewer splits than the cluster has cores.

    A table stored as one file with one row group is read by a single task,
    and every row-wise step before the first shuffle (regex splits, edit
    distances, encoding) would run on one core.  Only then the rows are dealt
    round-robin over ``defaultParallelism`` tasks; a large, well-split input
    is left as it is (no extra shuffle)."""
    spark = df.sparkSession
    target = min_parts or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))
