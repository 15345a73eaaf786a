"""Watermarked window counts over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.held import fresh_path


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None, gap: str | None = None) -> DataFrame:
    """Counts per window and event type of a stream or table with ts and event_type: tumbling, sliding with ``slide``, sessions of a user with ``gap``.

    Rows over ``late`` behind the latest event time seen are dropped from a stream; a window is given out once the watermark has passed it.
    """
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    if gap:
        return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")


def run_to_table(counts: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream until its input is used up, into parquet files at ``path``; state and progress are in ``checkpoint``, so that it can go on later."""
    query = counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return counts.sparkSession.read.schema(counts.schema).parquet(path)


def hourly_counts(spark: SparkSession, path: str, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """hour, event_type, count of a parquet table read as a stream; the windows still open at its end are counted from the table itself."""
    events = events_stream(spark, path)
    root = fresh_path(spark, "counts")
    closed = run_to_table(windowed_counts(events, late, size), f"{root}/out", f"{root}/state")
    last = closed.agg(F.max("start")).first()[0]
    rest = windowed_counts(spark.read.parquet(path), size=size)
    out = closed if last is None and closed.limit(1).count() else closed.union(rest if last is None else rest.where(F.col("start") > F.lit(last)))
    return out.select(F.col("start").alias("hour"), "event_type", F.col("n").alias("count"))


def events_stream(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table, a file or a folder of files, as a stream."""
    folder, _, name = path.rpartition("/")
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    return source.parquet(path) if _is_folder(spark, path) else source.option("pathGlobFilter", name).parquet(folder)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
