"""Written intermediate tables and the folder that driver and executors share.

The driver owns what it writes there: its file system deletes the tables when the driver's JVM ends, whether or not the session was stopped before (a driver
that is killed leaves them).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where a local session has none."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sievewright-"))
    return sc.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """An existing path goes when the driver's JVM ends."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(p)


def held(df: DataFrame, name: str = "held") -> DataFrame:
    """``df`` written once and read again: what follows neither computes it twice nor hangs on lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    gone_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
