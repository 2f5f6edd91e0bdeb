"""Reading the tables of one directory, and sizing small inputs for Python stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPREAD_BYTES_PER_CORE = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``sf_dir``; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, bytes_per_core: int = SPREAD_BYTES_PER_CORE) -> DataFrame:
    """Give every core a share of a *small* input before a CPU-bound Python stage.

    A table of one row group is one task, whatever the cluster. The estimate of Catalyst decides:
    beyond ``bytes_per_core`` for each core the scan has splits enough and nothing is shuffled. This changes
    the plan and never the rows; a small input pays one shuffle of its columns for it.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * bytes_per_core else df
