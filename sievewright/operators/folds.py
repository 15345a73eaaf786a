"""Seeded orders, class folds and group folds of any number of rows and groups.

Whole groups are dealt greedily: those whose classes differ most first, each to the fold that keeps the classes' shares most even. Groups with equal counts
of positives and rows are interchangeable, so the dealing runs over such signatures with their multiplicity, and it only looks at how the folds differ from each
other: once that repeats, the choices repeat, and the rest of a signature is a repeated pattern. What comes out is what dealing group by group gives,
from a table that is as long as there are signatures; the groups find their turn by their rank in a seeded order, summed up over ranges.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.held import held
from .evaluation import running_counts


def seeded(seed: int | str, *columns: str) -> F.Column:
    """A digest that orders rows by chance, the same one for the same seed and values."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def draw_order(rows: DataFrame, by: list[str], key: str, seed: int | str = 0, name: str = "at") -> DataFrame:
    """``rows`` with the place (from 0) of their ``key`` in a seeded order within ``by``; rows of one key share its place, what counts is the rows before.

    ``by`` may hold a seed of its own: it enters the digest."""
    keyed = held(rows.withColumn("_draw", seeded(seed, *by, key)), "draw")
    cells = running_counts(keyed.groupBy(*by, "_draw").agg(F.count("*").alias("_c")), by, "_draw", "_c")
    return keyed.join(cells.select(*by, "_draw", F.col("before").alias(name)), [*by, "_draw"]).drop("_draw")


class Dealer:
    """The greedy dealing: which fold the next group goes to, given how many positives and negatives the folds hold beyond the least of them."""

    def __init__(self, folds: int, positives: int, negatives: int):
        self.folds, self.total, self.state = folds, (max(1, positives), max(1, negatives)), ((0, 0),) * folds

    def choice(self, size: tuple[int, int]) -> int:
        sums = [sum(f[c] for f in self.state) for c in (0, 1)]
        squares = [sum(f[c] ** 2 for f in self.state) for c in (0, 1)]
        best = None
        for i, fold in enumerate(self.state):
            spread = 0.0
            for c in (0, 1):
                s, q = sums[c] + size[c], squares[c] + size[c] * (2 * fold[c] + size[c])
                spread += math.sqrt(self.folds * q - s * s) / self.total[c]
            key = (round(spread / (2 * self.folds), 12), fold[0] + fold[1])
            if best is None or key < best[0]:
                best = (key, i)
        return best[1]

    def step(self, size: tuple[int, int]) -> int:
        to = self.choice(size)
        now = [(f[0] + size[0], f[1] + size[1]) if i == to else f for i, f in enumerate(self.state)]
        low = min(f[0] for f in now), min(f[1] for f in now)
        self.state = tuple((f[0] - low[0], f[1] - low[1]) for f in now)
        return to

    def run(self, size: tuple[int, int], times: int) -> tuple[list[int], list[int]]:
        """The folds of ``times`` equal groups: first choices, then a pattern that repeats."""
        seen, made = {self.state: 0}, []
        while len(made) < times:
            made.append(self.step(size))
            if self.state in seen:
                begin = seen[self.state]
                pattern = made[begin:]
                for _ in range((times - len(made)) % len(pattern)):
                    self.step(size)
                return made[:begin], pattern
            seen[self.state] = len(made)
        return made, []


def dealing(signatures: list[tuple[int, int, int]], folds: int) -> list[tuple[int, int, list[int], list[int]]]:
    """(positives, rows, first choices, repeated pattern) of each signature (positives, rows, groups)."""
    dealer = Dealer(folds, sum(p * m for p, n, m in signatures), sum((n - p) * m for p, n, m in signatures))
    order = sorted(signatures, key=lambda s: (-abs(2 * s[0] - s[1]), s[0], s[1]))
    return [(p, n, *dealer.run((p, n - p), m)) for p, n, m in order]


def group_folds(rows: DataFrame, group: str = "grp", folds: int = 5, seed: int | str = 3, by: list[str] | None = None, y: str = "y") -> DataFrame:
    """``rows`` with ``fold``: whole groups within each ``by``, class shares kept even; a null group is one group."""
    rows = rows.withColumn("_unit", F.lit(0)) if not by else rows
    by = by or ["_unit"]
    groups = held(rows.groupBy(*by, F.col(group).alias("_grp")).agg(F.sum(y).cast("long").alias("_p"), F.count("*").alias("_n")).withColumn("_draw", seeded(seed, *by, "_grp")), "groups")
    signatures = groups.groupBy(*by, "_p", "_n").agg(F.count("*").alias("_m"))
    names = [f"{c} {t}" for c, t in signatures.select(*by).dtypes]

    def deal(table: pa.Table) -> pa.Table:
        made = dealing(list(zip(table["_p"].to_pylist(), table["_n"].to_pylist(), table["_m"].to_pylist())), folds)
        unit = [pa.array([table[c][0].as_py()] * len(made), table.schema.field(c).type) for c in by]
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        return pa.table([*unit, *[pa.array(c, k) for c, k in zip(zip(*made), kinds)]], names=[*by, "_p", "_n", "_first", "_pattern"])

    patterns = held(signatures.groupBy(*by).applyInArrow(deal, ", ".join([*names, "_p long, _n long, _first array<int>, _pattern array<int>"])), "patterns")
    ranked = running_counts(groups.withColumn("_one", F.lit(1)), [*by, "_p", "_n"], "_draw", "_one")
    ranked = held(ranked.select(*by, "_grp", "_p", "_n", "before"), "ranked").join(patterns, [*by, "_p", "_n"])
    first = F.size("_first")
    fold = F.when(F.col("before") < first, F.get("_first", F.col("before").cast("int"))).otherwise(F.get("_pattern", ((F.col("before") - first) % F.size("_pattern")).cast("int")))
    dealt = held(ranked.select(*[F.col(c).alias(f"_of_{c}") for c in by], "_grp", fold.alias("fold")), "dealt")
    same = F.col(group).eqNullSafe(F.col("_grp"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return rows.join(dealt, same).drop("_grp", "_unit", *[f"_of_{c}" for c in by])


def class_folds(rows: DataFrame, key: str, folds: int = 5, seed: int | str = 3, by: list[str] | None = None, y: str = "y") -> DataFrame:
    """``rows`` with ``fold``: each class dealt round in a seeded order within ``by``."""
    placed = draw_order(rows, [*(by or []), y], key, seed, "_at")
    return placed.withColumn("fold", ((F.col("_at") + 2 * F.col(y)) % folds).cast("int")).drop("_at")
