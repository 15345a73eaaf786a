"""Append-only labels with undo as a stream: what each key's label is, across restarts and late rows.

A row is a label, or takes back the last one that stands ("undo"), in the order of its sequence number. The state of a key is the stack of labels up to what is settled
and the rows since; rows that come late take their place among these. A timer folds rows into the stack once the watermark has passed them by ``late``, so the rows
kept are those of the last ``late`` alone; a key has one timer, that of the first row kept, and a timer settles all that the watermark has passed; what comes later than that is dropped and counted. Every batch gives out the keys it touched, latest wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

UNDO = "undo"


def _struct(**fields) -> StructType:
    """Spelled out, since workers have no session to parse a schema with."""
    return StructType([StructField(name, kind(), True) for name, kind in fields.items()])


OUT = _struct(key=StringType, seq=LongType, label=StringType, versions=LongType, dropped=LongType)


def folded(stack: list[str], rows: list[tuple[int, str]]) -> list[str]:
    """The labels that stand after ``rows`` (seq, label or undo), in their order."""
    out = list(stack)
    for _, label in sorted(rows):
        if label != UNDO:
            out.append(label)
        elif out:
            out.pop()
    return out


class History(StatefulProcessor):
    """One key's stack of settled labels, the rows since, and how many rows it has seen and dropped."""

    def __init__(self, late_ms: int):
        self.late = late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", _struct(seq=LongType, at=LongType, label=StringType))
        self.stack = handle.getListState("stack", _struct(label=StringType))
        self.sums = handle.getValueState("sums", _struct(settled=LongType, last=LongType, versions=LongType, dropped=LongType))

    def _known(self) -> list[int]:
        return list(self.sums.get()) if self.sums.exists() else [-1, -1, 0, 0]

    def _rows(self) -> list[tuple[int, int, str]]:
        return [tuple(r) for r in self.rows.get()] if self.rows.exists() else []

    def _stack(self) -> list[str]:
        return [r[0] for r in self.stack.get()] if self.stack.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        settled, last, versions, dropped = self._known()
        kept = self._rows()
        for frame in rows:
            for seq, at, label in zip(frame["seq"], frame["at"], frame["label"]):
                if seq <= settled:
                    dropped += 1
                    continue
                kept.append((int(seq), int(at), str(label)))
                last, versions = max(last, int(seq)), versions + (label != UNDO)
        self.sums.update((settled, last, versions, dropped))
        if kept:
            self.rows.put(kept)
            self._wait_for(min(kept))
        stands = folded(self._stack(), [(s, x) for s, _, x in kept])
        yield pd.DataFrame({"key": [str(key[0])], "seq": [last], "label": [stands[-1] if stands else None], "versions": [versions], "dropped": [dropped]})

    def _wait_for(self, first: tuple[int, int, str]) -> None:
        """The one timer of the key is that of its first row: no later row can be settled before it."""
        due, known = first[1] + self.late, list(self.handle.listTimers())
        for timer in known:
            if timer != due:
                self.handle.deleteTimer(timer)
        if due not in known:
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Rows whose time has passed are settled, up to the first that has not."""
        passed, kept = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()), sorted(self._rows())
        upto = passed - self.late
        n = next((i for i, r in enumerate(kept) if r[1] > upto), len(kept))
        if n:
            settled, last, versions, dropped = self._known()
            stack = folded(self._stack(), [(s, x) for s, _, x in kept[:n]])
            self.stack.put([(x,) for x in stack]) if stack else self.stack.clear()
            if kept[n:]:
                self.rows.put(kept[n:])
                self.handle.registerTimer(kept[n][1] + self.late)
            else:
                self.rows.clear()
            self.sums.update((kept[n - 1][0], last, versions, dropped))
        elif kept:
            self._wait_for(kept[0])
        return iter([])

    def close(self) -> None:
        pass


def label_states(events: DataFrame, late: str = "1 hour", late_ms: int = 3_600_000) -> DataFrame:
    """The stream of ``OUT`` rows of a stream (key, seq, label, ts); needs the RocksDB state store."""
    rows = events.select(F.col("key").cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), "label", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    rows = rows.withColumn("at", F.unix_millis("ts"))
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=History(late_ms), outputStructType=OUT, outputMode="Update", timeMode="EventTime")


def run(events: DataFrame, path: str, checkpoint: str, **how) -> DataFrame:
    """Runs the stream until its input is used up; batches are appended as files with their number, the result is the last word on each key. May be run again on the same folders."""
    spark = events.sparkSession
    states = label_states(events, **how)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")  # a batch that is tried again replaces itself

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return latest(spark, path)


def latest(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(f"{path}/batch=*")
    return rows.groupBy("key").agg(F.max_by(F.struct("seq", "label", "versions", "dropped"), "batch").alias("r")).select("key", "r.*")


def batch_states(events: DataFrame) -> DataFrame:
    """The same of a table: key, seq, label, versions, by a fold over each key's rows in order."""
    rows = F.sort_array(F.collect_list(F.struct(F.col("seq").cast("long").alias("seq"), "label")))
    step = lambda s, r: F.when(r["label"] != UNDO, F.concat(s, F.array(r["label"]))).otherwise(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))))
    stands = F.aggregate("rows", F.array().cast("array<string>"), step)
    out = events.groupBy(F.col("key").cast("string").alias("key")).agg(rows.alias("rows"), F.count_if(F.col("label") != UNDO).alias("versions"))
    return out.select("key", F.array_max("rows.seq").alias("seq"), F.element_at(F.when(F.size(stands) > 0, stands), -1).alias("label"), "versions")
