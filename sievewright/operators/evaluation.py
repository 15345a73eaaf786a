"""Tie-aware ranks and metrics of scores by group, without gathering a group's rows in one task.

Distinct values are counted, dealt by ranges of (group, value) and summed up within a task; the totals of the tasks before
(a row for each task and group) are added. Null scores are left out; one class gives a null AUC. Tables that grow with the rows are
joined by sort and merge: written tables are far smaller than what they hold, and a broadcast of one by its size in files overflows the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.held import held


def running_counts(cells: DataFrame, by: list[str], value: str, count: str) -> DataFrame:
    """``cells`` (one row per group and value) with ``before`` and ``total``: rows of smaller values, and of the group."""
    dealt = cells.repartitionByRange(*by, value).sortWithinPartitions(*by, value).withColumn("_task", F.spark_partition_id())
    dealt = held(dealt, "ranges")
    sums = dealt.groupBy("_task", *by).agg(F.sum(count).alias("_sum"))
    offsets = sums.withColumn("_off", F.sum("_sum").over(Window.partitionBy(*by).orderBy("_task")) - F.col("_sum")).withColumn("total", F.sum("_sum").over(Window.partitionBy(*by)))
    inside = F.sum(count).over(Window.partitionBy("_task", *by).orderBy(value)) - F.col(count)
    offsets = offsets.select(F.col("_task").alias("_of"), *[F.col(c).alias(f"_of_{c}") for c in by], "_off", "total")
    same = F.col("_task") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))  # a null group is a group
    out = dealt.withColumn("_in", inside).join(offsets.hint("merge"), same)
    return out.withColumn("before", F.col("_in") + F.col("_off")).drop("_task", "_in", "_off", "_of", *[f"_of_{c}" for c in by])


def share_ranks(rows: DataFrame, by: str, key: str, values: list[str]) -> DataFrame:
    """``rows`` with rank_<value> for each value: average-tie percent rank within ``by`` among non-null values."""
    rows = held(rows, "rows")
    long = rows.select(key, by, F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("v")) for v in values])).alias("s")).select(key, by, "s.name", "s.v").where("v is not null")
    cells = running_counts(long.groupBy(by, "name", "v").agg(F.count("*").alias("c")), [by, "name"], "v", "c")
    ranks = long.join(cells.select(by, "name", "v", ((F.col("before") + (F.col("c") + 1) / 2) / F.col("total")).alias("r")).hint("merge"), [by, "name", "v"])
    wide = ranks.groupBy(key).agg(*[F.max(F.when(F.col("name") == v, F.col("r"))).alias(f"rank_{v}") for v in values])
    return rows.join(wide.hint("merge"), key, "left")


def tied_auc(rows: DataFrame, by: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """``by``, n, n_pos, auc."""
    return counted_auc(rows.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count("*").alias("c"), F.sum(y).alias("p")), by, score)


def counted_auc(cells: DataFrame, by: list[str], score: str) -> DataFrame:
    """``tied_auc`` of distinct scores with c, their rows, and p, their sum of y."""
    cells = running_counts(cells, by, score, "c").withColumn("r", F.col("before") + (F.col("c") + 1) / 2)
    n1, n = F.sum("p"), F.sum("c")
    auc = (F.sum(F.col("p") * F.col("r")) - n1 * (n1 + 1) / 2) / F.nullif((n1 * (n - n1)).cast("double"), F.lit(0.0))
    return cells.groupBy(*by).agg(n.alias("n"), n1.cast("long").alias("n_pos"), F.round(auc, 6).alias("auc"))


def places(rows: DataFrame, by: list[str], order: list, before: str = "before", total: str = "total") -> DataFrame:
    """``rows`` with the number of rows of their ``by`` that come before in ``order`` (columns or names, nulls first), and of all; rows that are equal there share it."""
    keyed = rows.withColumn("_at", F.struct(*[F.col(o) if isinstance(o, str) else o for o in order]))
    keyed = held(keyed, "placed")
    cells = running_counts(keyed.groupBy(*by, "_at").agg(F.count("*").alias("_c")), by, "_at", "_c")
    cells = held(cells.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_at").alias("_key"), F.col("before").alias(before), F.col("total").alias(total)), "places")
    same = F.col("_at") == F.col("_key")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return keyed.join(cells.hint("merge"), same).drop("_at", "_key", *[f"_of_{c}" for c in by])
