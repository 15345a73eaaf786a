"""Sinks: overwritten parquet, CSV and JSON reports, and JSON lines that are appended to."""

from __future__ import annotations

from pyspark.sql import DataFrame


def sink_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Overwrites ``path``; one folder per value of ``partition_by``."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def sink_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def sink_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def append_jsonl(df: DataFrame, path: str) -> str:
    """Adds ``df`` to the log at ``path``; rows already there stay."""
    df.write.mode("append").option("ignoreNullFields", False).json(path)
    return path
