"""Joins and unions that check what pandas' ``validate`` checks, and a range join without a cross product."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assert_unique(df: DataFrame, on: list[str], side: str) -> None:
    """An error if two rows share a key; nulls are no keys. One aggregate, one row to the driver."""
    twice = df.dropna(subset=on).groupBy(*on).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"keys {on} repeat on the {side}: {twice[0].asDict()}")


def validated_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", validate: str = "one_to_one") -> DataFrame:
    """An equi-join whose key uniqueness is checked first: one_to_one, many_to_one or one_to_many."""
    if validate not in ("one_to_one", "many_to_one", "one_to_many"):
        raise ValueError(f"unknown validation {validate}")
    if validate.startswith("one"):
        assert_unique(left, on, "left")
    if validate.endswith("one"):
        assert_unique(right, on, "right")
    return left.join(right, on, how)


def union_strict(*frames: DataFrame) -> DataFrame:
    """Union by name of frames with the same columns and types; an error names what differs."""
    want = {f.name: f.dataType.simpleString() for f in frames[0].schema}
    for i, df in enumerate(frames[1:], 1):
        have = {f.name: f.dataType.simpleString() for f in df.schema}
        if have != want:
            raise ValueError(f"frame {i} differs in {sorted(set(have.items()) ^ set(want.items()))}")
    return reduce(DataFrame.unionByName, frames)


def range_join(points: DataFrame, spans: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Rows of ``points`` with the rows of ``spans`` where low <= at < high, as an equi-join on bins of ``width``.

    A span is repeated for each bin that it meets, so ``width`` should be near a usual span; nulls match nothing.
    """
    binned = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return points.withColumn("_bin", F.floor(F.col(at) / width)).join(binned, "_bin").where((F.col(low) <= F.col(at)) & (F.col(at) < F.col(high))).drop("_bin")
