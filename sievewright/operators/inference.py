"""Tests of significance: sums over counted ties by ranges of values, p-values as column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import normal_two_sided, student_two_sided
from ..plans.catalogue import CATALOGUE as C
from ..plans.held import held
from .evaluation import running_counts


def mann_whitney(rows: DataFrame, by: str = "silo", score: str = "s", y: str = "y") -> DataFrame:
    """``by``, u (of the positives), rank_biserial, z and two-sided p of the normal approximation, corrected for ties and continuity.

    Rows without a score are left out, and so are groups of one class; equal scores throughout give a null z and p.
    """
    cells = rows.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(by, score).agg(F.count("*").alias("c"), F.sum(y).alias("k"))
    cells = running_counts(cells, [by], score, "c")
    c = F.col("c").cast("double")
    sums = cells.groupBy(by).agg(F.sum("c").cast("double").alias("n"), F.sum("k").cast("double").alias("n1"), F.sum(F.col("k") * (F.col("before") + (c + 1) / 2)).alias("ranks"), F.sum(c * c * c - c).alias("ties"))
    sums = sums.withColumn("n0", F.col("n") - F.col("n1")).where("n1 > 0 and n0 > 0").withColumn("u", F.col("ranks") - F.col("n1") * (F.col("n1") + 1) / 2)
    pairs = F.col("n1") * F.col("n0")
    sd = F.nullif(F.sqrt(pairs / 12 * (F.col("n") + 1 - F.col("ties") / (F.col("n") * (F.col("n") - 1)))), F.lit(0.0))
    away = F.abs(F.col("u") - pairs / 2)
    corrected = F.greatest(F.lit(0.0), away - 0.5) / sd
    return sums.select(by, F.col("u"), (1 - 2 * F.col("u") / pairs).alias("rank_biserial"), (away / sd).alias("z"), normal_two_sided(corrected).alias("p"))


def paired_t(rows: DataFrame, by: str = "silo", one: str = "s", two: str = "s2") -> DataFrame:
    """``by``, t, df and two-sided p of the mean difference of complete pairs; null with fewer than two pairs or without spread."""
    d = F.col(one).cast("double") - F.col(two).cast("double")
    sums = rows.groupBy(by).agg(F.avg(d).alias("m"), F.stddev_samp(d).alias("sd"), F.count(d).alias("n"))
    t = F.col("m") / (F.nullif("sd", F.lit(0.0)) / F.sqrt(F.col("n").cast("double")))
    return sums.withColumn("t", F.when(F.col("n") > 1, t)).withColumn("df", F.col("n") - 1).select(by, "t", "df", student_two_sided(F.col("t"), F.col("df")).alias("p"))


def later_minimum(cells: DataFrame, value: str, of: str) -> DataFrame:
    """``cells`` (one row a value) with ``least``: the smallest ``of`` among rows of the same or a larger value, from the ranges' own and the least of the ranges after."""
    dealt = held(cells.repartitionByRange(value).sortWithinPartitions(value).withColumn("_task", F.spark_partition_id()), "ranges")
    ends = dealt.groupBy("_task").agg(F.min(of).alias("_least"))  # a row a range
    after = ends.select("_task", F.min("_least").over(Window.orderBy(F.col("_task").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"))
    inside = F.min(of).over(Window.partitionBy("_task").orderBy(F.col(value).desc()))
    return dealt.withColumn("_in", inside).join(after, "_task").withColumn("least", F.least("_in", "_after")).drop("_task", "_in", "_after")


def false_discovery(rows: DataFrame, key: str, p: str) -> DataFrame:
    """key, q: Benjamini and Hochberg's adjusted p-values over all rows with one, zeros among them; equal p-values share the q of the last."""
    known = held(rows.select(key, F.col(p).cast("double").alias("p")).where("p is not null"), "tests")
    cells = running_counts(known.withColumn("_all", F.lit(0)).groupBy("_all", "p").agg(F.count("*").alias("c")), ["_all"], "p", "c")
    cells = later_minimum(cells.select("p", (F.col("p") * F.col("total") / (F.col("before") + F.col("c"))).alias("raised")), "p", "raised")
    return known.join(cells.select("p", F.least(F.lit(1.0), "least").alias("q")), "p").select(key, "q")


def _scored(s, d):
    return C.view_frame(s, "scored", lambda t: s.read.parquet(f"{d}/{t}.parquet"))


def _rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.select(*[F.round(c, places.get(c, 6)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


QUERIES = {
    "mann_whitney_u": lambda s, d: _rounded(mann_whitney(_scored(s, d)), u=4, z=5), "paired_t": lambda s, d: _rounded(paired_t(_scored(s, d))),
    "benjamini_hochberg": lambda s, d: _rounded(false_discovery(_scored(s, d), "paper_id", "s")),
}


def oracles() -> dict[str, str]:
    """Tails by Simpson's rule over 4,000 strips, ranks as counts of pairs, q-values row by row."""
    v = C.sql_views("scored")
    strips = "(SELECT unnest(range(0, 4001)) AS i)"
    weight = "CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    inner = lambda edge, density: f"1 - 2 * {edge} / 4000 / 3 * sum({weight} * {density})"
    return {
        "mann_whitney_u": f"""WITH {v}, p AS (SELECT a.silo, sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) AS u FROM scored a JOIN scored b ON a.silo = b.silo AND a.y = 1 AND b.y = 0 GROUP BY a.silo),
g AS (SELECT silo, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS n1, count(*) - sum(y)::DOUBLE AS n0 FROM scored WHERE s IS NOT NULL GROUP BY silo), t AS (SELECT silo, sum(c * c * c - c) AS ties FROM (SELECT silo, count(*)::DOUBLE AS c FROM scored WHERE s IS NOT NULL GROUP BY silo, s) GROUP BY silo),
m AS (SELECT silo, u, n1 * n0 AS pairs, sqrt(n1 * n0 / 12 * (n + 1 - ties / (n * (n - 1)))) AS sd FROM p JOIN g USING (silo) JOIN t USING (silo)), z AS (SELECT *, abs(u - pairs / 2) / sd AS z, greatest(0, abs(u - pairs / 2) - 0.5) / sd AS x FROM m)
SELECT silo, round(any_value(u), 4) AS u, round(any_value(1 - 2 * u / pairs), 6) AS rank_biserial, round(any_value(z), 5) AS z, round({inner('any_value(x)', 'exp(-(x * i / 4000) * (x * i / 4000) / 2) / sqrt(2 * pi())')}, 6) AS p FROM z, {strips} GROUP BY silo""",
        "paired_t": f"""WITH {v}, m AS (SELECT silo, avg(s - s2) / (stddev_samp(s - s2) / sqrt(count(s - s2))) AS t, count(s - s2) - 1 AS df FROM scored GROUP BY silo),
c AS (SELECT *, exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi()) AS k FROM m) SELECT silo, round(any_value(t), 6) AS t, any_value(df) AS df, round({inner('any_value(abs(t))', 'k * pow(1 + (t * i / 4000) * (t * i / 4000) / df, -(df + 1) / 2.0)')}, 6) AS p FROM c, {strips} GROUP BY silo""",
        "benjamini_hochberg": f"WITH {v}, p AS (SELECT paper_id, s, (SELECT count(*) FROM scored b WHERE b.s <= a.s) AS r, (SELECT count(s) FROM scored) AS m FROM scored a WHERE s IS NOT NULL) SELECT a.paper_id, round(least(1, min(b.s * b.m / b.r)), 6) AS q FROM p a JOIN p b ON b.s >= a.s GROUP BY a.paper_id",
    }
