"""Scratch tables, byte columns and connected components for the corpus operators."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Seconds between collections on driver and JVM that free the shuffle files behind written tables (None: never); without
#: them the files stay until the JVM collects by itself, which costs disk (about the input's size per stage) and changes no result.
FREE_SHUFFLES: float | None = 2.0
_freed = [0.0]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or our own in a local session where it is unset."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sievewright-"))
    return sc.getCheckpointDir().rstrip("/")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Scratch:
    """Written tables that cut lineage; they outlive lost executors and go when the session's driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.drop)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        schema = df.schema
        del df
        if FREE_SHUFFLES is not None and time.monotonic() - _freed[0] > FREE_SHUFFLES:
            _freed[0] = time.monotonic()
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, name: str = "") -> None:
        sc = self.spark.sparkContext
        if sc._jsc is None:
            return
        try:
            path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the gateway may be gone at exit  # noqa: BLE001
            if name:
                raise


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, b"" for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes], most: int):
    """Index ranges of about ``most`` bytes; one longer text stands alone."""
    begin, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield begin, i
            begin, total = i, 0
        total += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, root) for every node of ``edges`` (src, dst): root is the smallest node reachable.

    Alternating large-star and small-star rounds; each round's edges are written to the shared
    folder, so a lost executor costs one round at most. Nothing but two counters reaches the driver.
    """
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    now = scratch.save(edges.where("src != dst").select(b.alias("u"), a.alias("v")).distinct(), f"{name}0")
    seen, i = None, 0
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the joins deal both sides anew and a hub's rows can be split
        low = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}low{i}")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        large = scratch.save(large.distinct(), f"{name}large{i}")
        near = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}near{i}")
        small = large.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        step = small.union(near.select("u", F.col("m").alias("v"))).distinct()
        i += 1
        old, now = now, scratch.save(step, f"{name}{i}")
        del both, low, large, near, small, step, old
        for part in (name, f"{name}low", f"{name}large", f"{name}near"):
            scratch.drop(f"{part}{i - 1}")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = mark
