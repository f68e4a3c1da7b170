"""Continuous intake: drop folders, event logs and windowed audits.

Batch tables drive the streams here through the ``availableNow`` trigger; the same
plans run with any other trigger. Checkpoints lie in the shared folder, so a lost
driver or executor resumes where it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.session import scratch_path
from quillspan.sources.tables import table


def event_stream(spark: SparkSession, base: str) -> DataFrame:
    schema = table(spark, base, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(base)


def _drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream to its end into a table under the shared folder."""
    spark = stream.sparkSession
    out, check = scratch_path(spark, "stream"), scratch_path(spark, "progress")
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    else:
        # a complete result replaces the last one
        write = lambda df, n: df.write.mode("overwrite").parquet(out)
        q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def without_repeats(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events once each by id, with state bounded by the watermark."""
    e = events.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", delay)
    return e.dropDuplicatesWithinWatermark(["event_id"]).drop("t")


def windowed_counts(events: DataFrame, length: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(event_type, start, n_events) of tumbling windows; late data up to ``delay``."""
    e = events.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", delay)
    g = e.groupBy(F.window("t", length).alias("w"), "event_type").agg(F.count("*").alias("n_events"))
    return g.select("event_type", F.col("w.start").alias("start"), "n_events")


def stream_totals(spark: SparkSession, base: str) -> DataFrame:
    """Running totals per event type."""
    e = event_stream(spark, base)
    return _drain(e.groupBy("event_type").agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 4).alias("total_value")), "complete")


def stream_state(spark: SparkSession, base: str) -> DataFrame:
    """(user_id, n_events, last_event): own state per user, kept by the engine."""
    e = event_stream(spark, base).select("user_id", "event_id")
    out, state = "user_id long, n_events long, last_event long", "n long, last long"

    def fold(key: tuple, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        n, last = held.get if held.exists else (0, -1)
        for p in parts:
            n, last = n + len(p), max(last, int(p["event_id"].max()))
        held.update((n, last))
        yield pd.DataFrame({"user_id": [key[0]], "n_events": [n], "last_event": [last]})

    s = e.groupBy("user_id").applyInPandasWithState(fold, out, state, "update", "NoTimeout")
    spark_ = e.sparkSession
    path, check = scratch_path(spark_, "state"), scratch_path(spark_, "progress")
    write = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(path)
    s.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    rows = spark_.read.parquet(path)
    return rows.groupBy("user_id").agg(F.max_by(F.struct("n_events", "last_event"), "batch").alias("r")).select("user_id", "r.*")


def watch_folder(spark: SparkSession, folder: str, ingest: Callable[[DataFrame], None], checkpoint: str | None = None):
    """Feed files that appear in a folder to a batch ingest plan, each file once."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return (
        files.writeStream.foreachBatch(lambda df, _: ingest(df))
        .option("checkpointLocation", checkpoint or scratch_path(spark, f"watch-{uuid.uuid4().hex}"))
        .trigger(availableNow=True)
        .start()
    )
