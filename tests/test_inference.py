"""P-values against closed forms, false discovery rates row by row."""

import math

import numpy as np
from pyspark.sql import functions as F

from sievewright.functions.distributions import normal_two_sided, student_two_sided
from sievewright.operators import inference


def test_normal_tails(spark):
    zs = [0.0, 0.01, 0.5, 1.0, 1.7, 1.74, 1.96, 3.0, 5.0, 8.0, 20.0, 37.0]
    for r in spark.createDataFrame([(z,) for z in zs], "z double").select("z", normal_two_sided(F.col("z")).alias("p")).collect():
        assert abs(r.p - math.erfc(r.z / math.sqrt(2))) <= 1e-11 * math.erfc(r.z / math.sqrt(2))


def student(t, v):
    """Finite sums of powers of the cosine (odd and even degrees of freedom)."""
    at = math.atan(t / math.sqrt(v))
    if v % 2:
        total, term = 0.0, math.cos(at)
        for k in range(1, (v - 1) // 2 + 1):
            total, term = total + term, term * math.cos(at) ** 2 * 2 * k / (2 * k + 1)
        return 1 - 2 / math.pi * (at + math.sin(at) * total)
    total, term = 0.0, 1.0
    for k in range(v // 2):
        total, term = total + term, term * math.cos(at) ** 2 * (2 * k + 1) / (2 * k + 2)
    return 1 - math.sin(at) * total


def test_student_tails(spark):
    cases = [(t, v) for t in (0.0, 0.1, 1.0, 2.0, 4.5, 12.0) for v in (1, 2, 3, 4, 7, 10, 51, 100, 1001)]
    for r in spark.createDataFrame(cases, "t double, v int").select("t", "v", student_two_sided(-F.col("t"), F.col("v")).alias("p")).collect():
        assert abs(r.p - student(r.t, r.v)) < 1e-9
    assert spark.range(1).select(student_two_sided(F.lit(2.0), F.lit(0))).first()[0] is None


def test_mann_whitney_and_paired_t_at_the_edges(spark):
    rows = [("a", 1, 2.0, 1.0), ("a", 0, 1.0, 1.0), ("a", 0, None, 3.0), ("one class", 1, 1.0, 0.5), ("ties", 1, 1.0, 1.0), ("ties", 0, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "silo string, y int, s double, s2 double")
    got = {r.silo: r for r in inference.mann_whitney(frame).collect()}
    assert set(got) == {"a", "ties"} and got["a"].u == 1 and got["a"].rank_biserial == -1 and got["ties"].z is None and got["ties"].p is None
    t = {r.silo: r for r in inference.paired_t(frame).collect()}
    assert t["a"].df == 1 and abs(t["a"].p - 0.5) < 1e-12 and t["one class"].p is None and t["ties"].t is None
    none = frame.limit(0)
    assert inference.mann_whitney(none).count() == inference.paired_t(none).count() == 0


def test_false_discovery(spark):
    rng = np.random.default_rng(1)
    p = np.round(rng.random(700) ** 2, 2)
    p[:5] = 0
    got = {r.k: r.q for r in inference.false_discovery(spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)] + [(900, None)], "k long, p double").repartition(4), "k", "p").collect()}
    order = np.sort(p)[::-1]
    q = np.minimum.accumulate(order * len(p) / np.arange(len(p), 0, -1))
    want = dict(zip(order, q))  # the last of equal p-values
    for v, x in zip(order, q):
        want[v] = min(want[v], x)
    assert len(got) == 700 and all(abs(got[i] - min(1, want[v])) < 1e-12 for i, v in enumerate(p))
