"""Tails of the normal and Student's distribution as column expressions: continued fractions and series folded over a fixed number of terms."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMS, TINY = 400, 1e-300
#: Lanczos' coefficients for g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x of 1/2 and more."""
    z = x - 1
    series = sum((c / (z + i) for i, c in enumerate(LANCZOS[1:], 1)), F.lit(LANCZOS[0]))
    t = z + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.log(t) - t + F.log(series)


def _lentz(begin: Column, terms: Callable[[Column], list[tuple[Column, Column]]], inverse: float = 0.0) -> Column:
    """A continued fraction from what is known of it, ``begin``; ``terms(m)`` are the (numerator, denominator) of the m-th step, ``inverse`` the last denominator's."""
    safe = lambda v: F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)
    state = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h"))
    first = safe(begin)

    def step(s, m):
        c, d, h = s["c"], s["d"], s["h"]
        for a, b in terms(m.cast("double")):
            d = 1 / safe(b + a * d)
            c = safe(b + a / c)
            h = h * c * d
        return state(c, d, h)

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), state(first, F.lit(inverse), first), step)["h"]


def beta_tail(a: Column, b: Column, x: Column, rest: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b); ``rest`` is 1 - x, given apart for the digits it would lose."""

    def fraction(a, b, x):
        steps = lambda m: [(m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), F.lit(1.0)), (-(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), F.lit(1.0))]
        first = 1 - (a + b) * x / (a + 1)
        return 1 / _lentz(first, steps, 1.0)

    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(rest))
    inside = F.when(x < (a + 1) / (a + b + 2), front * fraction(a, b, x) / a).otherwise(1 - front * fraction(b, a, rest) / b)
    return F.when(x <= 0, 0.0).when(rest <= 0, 1.0).otherwise(inside)


def student_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) with ``df`` degrees of freedom."""
    t, df = t.cast("double"), df.cast("double")
    whole = df + t * t
    return F.when(df > 0, beta_tail(df / 2, F.lit(0.5), df / whole, t * t / whole))


def normal_two_sided(z: Column) -> Column:
    """P(|Z| >= |z|): the incomplete gamma function of 1/2 at z^2 / 2, by its series below 3/2 and its continued fraction above."""
    x = z.cast("double") * z.cast("double") / 2
    front = F.exp(-x + 0.5 * F.log(x)) / math.sqrt(math.pi)
    state = F.struct(F.lit(2.0).alias("term"), F.lit(2.0).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), state, lambda s, n: F.struct((s["term"] * x / (n + 0.5)).alias("term"), (s["sum"] + s["term"] * x / (n + 0.5)).alias("sum")))["sum"]
    fraction = _lentz(x + 0.5, lambda m: [(-m * (m - 0.5), x + 2 * m + 0.5)])
    return F.when(x == 0, 1.0).when(x < 1.5, 1 - front * series).otherwise(front / fraction)
