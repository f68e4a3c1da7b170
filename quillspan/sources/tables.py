"""Named tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Read ``<base>/<name>.parquet``: a file or a directory of part files."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use every core on an input of fewer splits than cores.

    Such an input is small (a few files), so dealing it out costs little; an input of
    many splits is left as it lies, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df
