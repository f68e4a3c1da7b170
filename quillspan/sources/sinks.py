"""Writers: versions of a document, logs without repeats, partitions replaced.

Every writer commits through Spark, so a lost executor repeats a task and a failed write
leaves what was there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_version(rows: DataFrame, path: str, replace: bool = False) -> None:
    """Rows as JSON lines at a path that is new, or replaced as a whole."""
    rows.write.mode("overwrite" if replace else "errorifexists").json(path)


def append_events(events: DataFrame, path: str, key: str = "event_id") -> None:
    """Append to a log of JSON lines the events whose id it does not have, the first of
    each; events without an id are not written."""
    spark = events.sparkSession
    first = events.filter(F.col(key).isNotNull()).dropDuplicates([key])
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        have = spark.read.schema(f"{key} {events.schema[key].dataType.simpleString()}").json(path)
        first = first.join(have, key, "left_anti")
    first.write.mode("append").json(path)


def reindex(chunks: DataFrame, changed: DataFrame, path: str, buckets: int = 64) -> None:
    """Replace the chunks of changed items in a table laid out in ``buckets`` by item: only
    the buckets that hold one are written anew. ``chunks`` are those of the changed items."""
    spark = chunks.sparkSession
    bucket = F.pmod(F.xxhash64("item_id"), F.lit(buckets)).cast("int").alias("bucket")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    rows = chunks.withColumn("bucket", bucket)
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        old = spark.read.parquet(path)
        touched = [r[0] for r in changed.select(bucket).distinct().collect()]  # at most ``buckets``
        kept = old.filter(F.col("bucket").isin(touched)).join(changed.select("item_id").distinct(), "item_id", "left_anti")
        from quillspan.session import cut

        rows = cut(kept.unionByName(rows.select(*kept.columns)), "reindex")
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
