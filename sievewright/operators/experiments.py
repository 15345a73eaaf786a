"""Cross-validation, budgets, ensembles, searches and staged evaluation over labelled tables.

Every experiment says which cells of rows (a fold, a silo, a band of drawn labels, ...) each model learns from and which it scores; ``manymodels`` fits all models of an
experiment in one pass over the shared rows, ``folds`` draws and deals, ``evaluation`` ranks, ``resampling`` gives intervals. Draws are digests of a seed and the
row's id. One-class models give no score, and what needs one is null or left out.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import fit_logit
from ..plans.held import held
from . import manymodels, resampling
from .boosting import ordered_gbt
from .evaluation import running_counts, tied_auc
from .folds import class_folds, draw_order, group_folds

SEEDS, FOLDS = 3, 5
#: Of the columns that ``labelled_table`` gives: four text measures, then the embedding.
TEXT = 4
#: Newton steps of a trial in a search, where ranks are compared and not coefficients.
SEARCH_STEPS = 10


def _each(name: str, values) -> F.Column:
    return F.explode(F.array(*[F.lit(v) for v in values])).alias(name)


def _key(*parts) -> F.Column:
    return F.concat_ws("|", *[p if not isinstance(p, str) else F.col(p).cast("string") for p in parts])


def _numbers(columns) -> F.Column:
    return F.lit(None).cast("array<int>") if columns is None else F.array(*[F.lit(int(c)) for c in columns])


def seed_of(*key) -> int:
    import zlib

    return zlib.crc32("|".join(map(str, key)).encode())


def cross_validated(rows: DataFrame, by: list[str], sets: dict[str, list[int] | None] | None = None, folds: int = FOLDS, c: float = 1.0) -> DataFrame:
    """paper_id, ``by``, set, fold, y, score: every row of (paper_id, y, x, fold, ``by``) scored by its unit's other folds, on each set of columns."""
    rows = held(rows, "folded")
    packed = manymodels.blocks(rows.select(_key(*by, "fold").alias("cell"), F.col("paper_id").alias("id"), "y", "x"))
    units = held(rows.select(*by, "fold").distinct(), "units")
    models = None
    for name, columns in (sets or {"": None}).items():
        part = units.select(*by, "fold", F.lit(name).alias("set"), _numbers(columns).alias("cols"))
        models = part if models is None else models.union(part)
    models = held(models.withColumn("model", _key("set", *by, "fold")).withColumn("c", F.lit(c)), "designs")
    others = units.select(*by, F.col("fold").alias("_f"))
    train = models.join(others, by).where("_f <> fold").select("model", _key(*by, "_f").alias("cell"))
    state = manymodels.fit(packed, models.select("model", "c", "cols"), train)
    got = manymodels.scores(packed, state, models.select("model", _key(*by, "fold").alias("cell")))
    return got.join(models.select("model", *by, "set", "fold"), "model").select(F.col("id").alias("paper_id"), *by, "set", "fold", "y", "score")


def within_silo_oof(rows: DataFrame, seeds: int = SEEDS, folds: int = FOLDS, groups: bool = True, columns: list[int] | None = None, shuffled: bool = False) -> DataFrame:
    """paper_id, silo, seed, fold, y, score: every labelled row scored once a seed by its silo's other folds.

    ``shuffled``: a silo's labels are dealt to its rows by chance, the positives to those that come first in a seeded order."""
    rows = rows.select("*", _each("seed", range(seeds)))
    if shuffled:
        placed = draw_order(rows, ["silo", "seed"], "paper_id", "shuffle", "_at")
        positives = rows.groupBy("silo", "seed").agg(F.sum("y").alias("_p"))
        rows = placed.join(positives, ["silo", "seed"]).withColumn("y", (F.col("_at") < F.col("_p")).cast("int")).drop("_at", "_p")
    rows = group_folds(rows, "grp", folds, by=["silo", "seed"]) if groups else class_folds(rows, "paper_id", folds, by=["silo", "seed"])
    return cross_validated(rows, ["silo", "seed"], {"": columns}, folds).drop("set")


def auc_by(rows: DataFrame, *by: str) -> DataFrame:
    return tied_auc(rows, list(by))


def cv_summary(oof: DataFrame) -> DataFrame:
    """silo, seed, per-fold AUCs, their mean and deviation."""
    folds = auc_by(held(oof, "oof"), "silo", "seed", "fold")
    each = F.transform(F.sort_array(F.collect_list(F.struct("fold", "auc"))), lambda x: x["auc"])
    return folds.groupBy("silo", "seed").agg(F.round(F.avg("auc"), 6).alias("mean_auc"), F.round(F.stddev_pop("auc"), 6).alias("sd_auc"), F.array_join(F.transform(each, lambda a: F.format_number(a, 4)), " ", "-").alias("fold_aucs"))


def seed_summary(oof: DataFrame) -> DataFrame:
    """silo, mean and deviation over seeds of the pooled out-of-fold AUC."""
    return auc_by(held(oof, "oof"), "silo", "seed").groupBy("silo").agg(F.max("n").alias("n"), F.max("n_pos").alias("n_pos"), F.round(F.avg("auc"), 6).alias("mean_auc"), F.round(F.stddev_samp("auc"), 6).alias("sd_auc"))


def _band(at: str, cuts) -> F.Column:
    """How many of the rising ``cuts`` the place has passed: band i is drawn by every budget from the i-th on."""
    return sum(((F.col(at) >= c).cast("int") for c in cuts), F.lit(0))


def warm_start(rows: DataFrame, budgets=(10, 20, 40, 80), seeds: int = SEEDS) -> DataFrame:
    """silo, budget, mean AUC over seeds: fitted on all other silos plus ``budget`` drawn labels of the silo, judged on the silo's rest; one-class draws are skipped."""
    rows = held(rows.select("paper_id", "silo", "y", "x"), "pool")
    drawn = held(draw_order(rows.select("*", _each("seed", range(seeds))), ["silo", "seed"], "paper_id", "warm").withColumn("band", _band("at", budgets)), "drawn")
    whole, own = _key(F.lit("all"), "silo"), _key(F.lit("own"), "silo", "seed", "band")
    packed = manymodels.blocks(rows.select(whole.alias("cell"), F.col("paper_id").alias("id"), "y", "x").union(drawn.select(own, "paper_id", "y", "x")))
    bands = held(drawn.groupBy("silo", "seed", "band").agg(F.sum("y").alias("p"), F.count("*").alias("n")), "bands")
    grid = bands.select("silo", "seed").distinct().select("*", F.posexplode(F.array(*[F.lit(b) for b in budgets])).alias("step", "budget"))
    within = grid.join(bands, ["silo", "seed"])
    two = within.where("band <= step").groupBy("silo", "seed", "step", "budget").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).where("p > 0 and p < n")
    models = held(two.withColumn("model", _key("silo", "seed", "step")), "designs")
    names = bands.select(F.col("silo").alias("other")).distinct()
    elsewhere = models.join(names, F.col("other") != F.col("silo")).select("model", _key(F.lit("all"), "other").alias("cell"))  # silos by models
    cells = models.select("model", "silo", "seed", "step").join(bands.select("silo", "seed", "band"), ["silo", "seed"]).withColumn("cell", own)
    state = manymodels.fit(packed, models.select("model", F.lit(1.0).alias("c"), _numbers(None).alias("cols")), elsewhere.union(cells.where("band <= step").select("model", "cell")))
    got = manymodels.scores(packed, state, cells.where("band > step")).join(models.select("model", "silo", "seed", "budget"), "model")
    return auc_by(got, "silo", "budget", "seed").where("auc is not null").groupBy("silo", "budget").agg(F.count("*").alias("n_seeds"), F.round(F.avg("auc"), 6).alias("auc"))


def _class_draws(rows: DataFrame, seeds: int, name: str) -> DataFrame:
    """Rows once a seed with their place ``at`` in a seeded order of their silo's class."""
    return held(draw_order(rows.select("*", _each("seed", range(seeds))), ["silo", "seed", "y"], "paper_id", name), "drawn")


def label_budgets(rows: DataFrame, positives=(2, 5, 10), negatives=(5, 10, 20), seeds: int = SEEDS) -> DataFrame:
    """silo, n_pos, n_neg, AUC on the rest over seeds, and its gain over the zero-label score ``floor_score``."""
    drawn = _class_draws(rows, seeds, "budget").withColumn("band", F.when(F.col("y") == 1, _band("at", positives)).otherwise(_band("at", negatives)))
    cell = _key("silo", "seed", "y", "band")
    packed = manymodels.blocks(drawn.select(cell.alias("cell"), F.col("paper_id").alias("id"), "y", "x"))
    bands = held(drawn.groupBy("silo", "seed", "y", "band").count(), "bands")
    sizes = bands.groupBy("silo", "seed").agg(F.sum(F.when(F.col("y") == 1, F.col("count"))).alias("p"), F.sum(F.when(F.col("y") == 0, F.col("count"))).alias("n"))
    grid = sizes.select("*", F.posexplode(F.array(*map(F.lit, positives))).alias("i", "n_pos")).select("*", F.posexplode(F.array(*map(F.lit, negatives))).alias("j", "n_neg"))
    models = held(grid.where("p > n_pos and n > n_neg").withColumn("model", _key("silo", "seed", "i", "j")).drop("p", "n"), "designs")
    cells = models.join(bands, ["silo", "seed"]).withColumn("cell", cell).withColumn("learns", F.col("band") <= F.when(F.col("y") == 1, F.col("i")).otherwise(F.col("j")))
    state = manymodels.fit(packed, models.select("model", F.lit(1.0).alias("c"), _numbers(None).alias("cols")), cells.where("learns").select("model", "cell"))
    got = manymodels.scores(packed, state, cells.where("not learns").select("model", "cell")).join(models, "model")
    got = held(got.join(rows.select(F.col("paper_id").alias("id"), "floor_score"), "id").withColumnsRenamed({"n_pos": "drawn_pos", "n_neg": "drawn_neg"}), "scored")
    by = ["silo", "seed", "drawn_pos", "drawn_neg"]
    gain = auc_by(got, *by).select(*by, "auc").join(tied_auc(got, by, "floor_score").select(*by, F.col("auc").alias("floor")), by).where("auc is not null")
    gain = gain.groupBy("silo", F.col("drawn_pos").alias("n_pos"), F.col("drawn_neg").alias("n_neg"))
    return gain.agg(F.count("*").alias("n_seeds"), F.round(F.avg("auc"), 6).alias("auc"), F.round(F.avg(F.col("auc") - F.col("floor")), 6).alias("gain"))


def induced_low_label(rows: DataFrame, per_class: int = 30, seeds: int = SEEDS) -> DataFrame:
    """silo, seed, AUC and recall in the first tenth of the rest after ``per_class`` drawn labels of each class; null where a class has no more than these."""
    drawn = _class_draws(rows, seeds, "low").withColumn("band", _band("at", [per_class]))
    cell = _key("silo", "seed", "band")
    packed = manymodels.blocks(drawn.select(cell.alias("cell"), F.col("paper_id").alias("id"), "y", "x"))
    units = held(drawn.groupBy("silo", "seed").agg(F.count_if((F.col("band") > 0) & (F.col("y") == 1)).alias("p"), F.count_if((F.col("band") > 0) & (F.col("y") == 0)).alias("n")), "units")
    models = held(units.where("p > 0 and n > 0").select("silo", "seed", _key("silo", "seed").alias("model")), "designs")
    at = lambda b: models.select("model", _key("silo", "seed", F.lit(b)).alias("cell"))
    state = manymodels.fit(packed, models.select("model", F.lit(1.0).alias("c"), _numbers(None).alias("cols")), at("0"))
    got = held(manymodels.scores(packed, state, at("1")).join(models, "model"), "scored")
    cells = got.withColumn("v", F.struct(-F.col("score"), F.col("id"))).groupBy("silo", "seed", "v").agg(F.count("*").alias("c"), F.sum("y").alias("p"))
    ranked = running_counts(cells, ["silo", "seed"], "v", "c")
    first = F.greatest(F.lit(1), F.round(0.1 * F.col("total")))
    recall = ranked.groupBy("silo", "seed").agg((F.sum(F.when(F.col("before") < first, F.col("p")).otherwise(0)) / F.greatest(F.lit(1), F.sum("p"))).alias("recall_10"))
    return units.select("silo", "seed").join(auc_by(got, "silo", "seed").select("silo", "seed", "auc"), ["silo", "seed"], "left").join(recall, ["silo", "seed"], "left")


def branches(width: int) -> dict[str, list[int]]:
    """Text lengths, marks, the embedding."""
    return {"lex": [0, 1], "marks": [2, 3], "emb": list(range(TEXT, width))}


def _width(rows: DataFrame) -> int:
    return rows.agg(F.max(F.size("x"))).first()[0] or 0


def stacked(rows: DataFrame, folds: int = FOLDS, sets: dict[str, list[int]] | None = None) -> DataFrame:
    """paper_id, silo, y, stack, blend, cut, pred: a logistic model over the branches' out-of-fold scores, itself out of fold.

    ``blend`` weighs the first two branches by the weight of 21 with the best AUC on the other folds (ties: the smallest); ``cut`` is the best F2 cut of 99 there (ties: the lowest).
    """
    sets = sets or branches(_width(rows))
    folded = held(group_folds(rows, "grp", folds, "stack", by=["silo"]), "folded")
    base = cross_validated(folded, ["silo"], sets, folds)
    wide = base.groupBy("paper_id", "silo", "fold").agg(F.first("y").alias("y"), *[F.max(F.when(F.col("set") == name, F.coalesce("score", F.lit(0.5)))).alias(f"s{i}") for i, name in enumerate(sets)])
    wide = held(wide.withColumn("x", F.array(*[f"s{i}" for i in range(len(sets))])), "base")
    meta = held(cross_validated(wide.select("paper_id", "silo", "fold", "y", "x"), ["silo"], None, folds).select("paper_id", "silo", F.col("fold").alias("own"), F.col("score").alias("stack")).join(wide, ["paper_id", "silo"]), "meta")
    other = F.explode(F.array(*[F.lit(k) for k in range(folds)]))
    tried = meta.select("silo", "own", "y", "s0", "s1", other.alias("k")).where("own <> k").select("silo", "k", "y", _each("w", range(21)), "s0", "s1").withColumn("score", F.col("w") / 20 * F.col("s0") + (1 - F.col("w") / 20) * F.col("s1"))
    weight = auc_by(tried, "silo", "k", "w").groupBy("silo", F.col("k").alias("own")).agg(F.max_by("w", F.struct(F.coalesce("auc", F.lit(0.0)), -F.col("w"))).alias("w"))
    # hits above each cut, from counts by the last cut that a score reaches
    reached = F.floor(F.round(F.coalesce("stack", F.lit(0.0)) * 100, 9)).cast("int")
    counts = meta.select("silo", "own", "y", reached.alias("q"), other.alias("k")).where("own <> k").groupBy("silo", "k", "q").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
    each = counts.groupBy("silo", "k").agg(F.collect_list(F.struct("q", "p", "n")).alias("h"), F.sum("p").alias("all"))  # at most 101 entries
    cuts = each.select("silo", F.col("k").alias("own"), "h", "all", _each("t", range(1, 100)))
    above = lambda f: F.aggregate(F.filter("h", lambda z: z["q"] >= F.col("t")), F.lit(0).cast("long"), lambda s, z: s + z[f])
    tp, hits = above("p"), above("n")
    f2 = F.when(tp > 0, F.round(5 * tp / (tp + hits - tp + 4 * F.col("all")), 9)).otherwise(0.0)
    cut = cuts.withColumn("f2", f2).groupBy("silo", "own").agg((F.max_by("t", F.struct("f2", -F.col("t"))) / 100).alias("cut"))
    out = meta.join(weight, ["silo", "own"], "left").join(cut, ["silo", "own"], "left").withColumn("blend", F.col("w") / 20 * F.col("s0") + (1 - F.col("w") / 20) * F.col("s1"))
    return out.select("paper_id", "silo", "y", "stack", "blend", "cut", (F.col("stack") >= F.col("cut")).cast("int").alias("pred"))


def isotonic(s: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float]]:
    """Ends and levels of the rising step function of least squares (pool adjacent violators), constant beyond its ends."""
    order = np.argsort(s, kind="stable")
    values: list[list[float]] = []
    for x, v in zip(s[order], y[order].astype(float)):
        values.append([v, 1.0, x])
        while len(values) > 1 and values[-2][0] >= values[-1][0]:
            b, a = values.pop(), values.pop()
            values.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], b[2]])
    return [float(v[2]) for v in values], [float(v[0]) for v in values]


def calibrated(rows: DataFrame, per_class: int = 25) -> DataFrame:
    """silo, method, Brier score before and after calibration of ``floor_score`` on ``per_class`` drawn labels of each class, judged on the rest.

    Curves are fitted on at most twice ``per_class`` rows of a silo, and applied to all others by column functions."""
    drawn = held(draw_order(rows.select("paper_id", "silo", "y", F.col("floor_score").alias("s")), ["silo", "y"], "paper_id", "calibrate").withColumn("learns", F.col("at") < per_class), "drawn")

    def curve(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("paper_id").reset_index(drop=True)
        s, y = f.s.to_numpy(), f.y.to_numpy()
        theta = fit_logit(s[:, None], y, c=1e6, balanced=False)
        return pd.DataFrame([(f.silo[0], float(theta[0]), float(theta[1]), *isotonic(s, y))], columns=["silo", "a", "b", "ends", "levels"])

    both = drawn.where("learns").groupBy("silo").agg(F.countDistinct("y").alias("k")).where("k = 2").select("silo")
    curves = drawn.where("learns").join(both, "silo").groupBy("silo").applyInPandas(curve, "silo string, a double, b double, ends array<double>, levels array<double>")
    rest = drawn.where("not learns").join(held(curves, "curves"), "silo")
    platt = 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), F.col("a") * F.col("s") + F.col("b")))))
    place = F.least(F.size(F.filter("ends", lambda e: e < F.col("s"))), F.size("ends") - 1)
    after = F.explode(F.array(F.struct(F.lit("platt").alias("method"), platt.alias("p")), F.struct(F.lit("isotonic").alias("method"), F.get("levels", place).alias("p"))))
    rest = rest.select("silo", "y", "s", after.alias("q")).select("silo", "q.method", F.pow(F.col("s") - F.col("y"), 2).alias("before"), F.pow(F.col("q.p") - F.col("y"), 2).alias("after"))
    return rest.groupBy("silo", "method").agg(F.avg("before").alias("brier_before"), F.avg("after").alias("brier_after"))


class Parzen:
    """Proposals from earlier trials: parameters that the best quarter has more often than the rest, by kernel densities (a tree-structured Parzen estimator)."""

    def __init__(self, space: dict[str, tuple], seed: int, good: float = 0.25, candidates: int = 24):
        self.space, self.rng, self.good, self.candidates = space, random.Random(seed), good, candidates

    def fresh(self) -> dict:
        return {k: (self.rng.uniform(*v[1:]) if v[0] == "uniform" else self.rng.choice(v[1])) for k, v in self.space.items()}

    def _density(self, name: str, value, seen: list) -> float:
        kind, *rest = self.space[name]
        if kind == "choice":
            return (1 + sum(s == value for s in seen)) / (len(rest[0]) + len(seen))
        low, high = rest
        width = max((high - low) / (1 + len(seen)), 1e-6)
        kernels = [1 / (high - low)] + [math.exp(-((value - s) / width) ** 2 / 2) / (width * math.sqrt(2 * math.pi)) for s in seen]
        return sum(kernels) / len(kernels)

    def _near(self, name: str, seen: list):
        """A draw from the density of ``seen``."""
        kind, *rest = self.space[name]
        at = self.rng.randrange(len(seen) + 1)
        if at == len(seen):
            return self.rng.uniform(*rest) if kind == "uniform" else self.rng.choice(rest[0])
        if kind == "choice":
            return seen[at]
        return min(rest[1], max(rest[0], self.rng.gauss(seen[at], (rest[1] - rest[0]) / (1 + len(seen)))))

    def propose(self, trials: list[tuple[dict, float]]) -> dict:
        """The candidate with the largest ratio of densities, good over other trials; a trial is (parameters, score), more is better."""
        ranked = sorted(trials, key=lambda t: -t[1])
        n = max(1, math.ceil(self.good * len(ranked)))
        best, rest = [t[0] for t in ranked[:n]], [t[0] for t in ranked[n:]]
        drawn = [{k: self._near(k, [b[k] for b in best]) for k in self.space} for _ in range(self.candidates)]
        gain = lambda d: sum(math.log(self._density(k, d[k], [b[k] for b in best])) - math.log(self._density(k, d[k], [r[k] for r in rest])) for k in self.space)
        return max(drawn, key=gain)


def hparam_search(rows: DataFrame, budget: int = 24, seed: int = 5, start: int = 8, batch: int = 4) -> DataFrame:
    """method, trial, c, n_columns, mean AUC over left-out silos, place: a grid, a seeded random search and Parzen proposals of equal budget; place 1 is a method's choice.

    Grid, random search and the proposals' ``start`` trials are one fit of many models; then ``batch`` proposals at a time are."""
    spark, width = rows.sparkSession, _width(rows)
    rows = held(rows.select("paper_id", "silo", "y", "x"), "pool")
    packed = manymodels.blocks(rows.select("silo", F.col("silo").alias("cell"), F.col("paper_id").alias("id"), "y", "x"))
    silos = held(rows.select("silo").distinct(), "silos")
    sizes = sorted({max(1, min(width, w)) for w in (2, 4, width // 4, width // 2, width)})
    rng, parzen = np.random.default_rng(seed), Parzen({"c": ("uniform", -3.0, 4.0), "n": ("choice", sizes)}, seed)
    trials = [("grid", i, float(10.0 ** (-3 + i % 8)), sizes[(i // 8) % len(sizes)]) for i in range(budget)]
    trials += [("random", i, float(10 ** rng.uniform(-3, 4)), int(sizes[rng.integers(len(sizes))])) for i in range(budget)]
    made = [parzen.fresh() for _ in range(min(start, budget))]
    trials += [("parzen", i, 10 ** p["c"], p["n"]) for i, p in enumerate(made)]
    known: list[tuple] = []
    while trials:
        frame = spark.createDataFrame(trials, "method string, trial int, c double, n_columns int")
        models = held(frame.join(F.broadcast(silos)).withColumn("model", _key("method", "trial", "silo")), "designs")  # a row a trial and silo
        train = models.select("model", "silo").join(silos.select(F.col("silo").alias("cell")), F.col("cell") != F.col("silo")).select("model", "cell")
        state = manymodels.fit(packed, models.select("model", "c", F.sequence(F.lit(0), F.col("n_columns") - 1).alias("cols")), train, SEARCH_STEPS, 1e-4)
        got = manymodels.scores(packed, state, models.select("model", F.col("silo").alias("cell"))).join(models, "model")
        means = auc_by(got, "method", "trial", "silo").groupBy("method", "trial").agg(F.round(F.avg("auc"), 6).alias("auc"))
        aucs = {(r["method"], r["trial"]): r["auc"] for r in means.collect()}  # a row a trial
        known += [(*t, aucs.get(t[:2])) for t in trials]
        mine = [({"c": math.log10(t[2]), "n": t[3]}, t[4] or 0.0) for t in known if t[0] == "parzen"]
        trials = []
        while mine and len(mine) < budget and len(trials) < batch:
            p = parzen.propose(mine)
            trials.append(("parzen", len(mine), 10 ** p["c"], p["n"]))
            mine.append((p, min(t[1] for t in mine)))  # taken for as bad as the worst until it is known, so that a batch spreads out
    places: dict = {}
    for name in ("grid", "random", "parzen"):
        for i, t in enumerate(sorted((t for t in known if t[0] == name), key=lambda t: (t[4] is None, -(t[4] or 0), t[1]))):
            places[t[:2]] = i + 1
    return spark.createDataFrame([(*t, places[t[:2]]) for t in known], "method string, trial int, c double, n_columns int, auc double, place int")


def column_sets(rows: DataFrame) -> DataFrame:
    """variant, silo, pooled out-of-fold AUC with each registered set of columns."""
    width = _width(rows)
    sets = {"lex": [0, 1], "marks": [2, 3], "no_emb": list(range(min(TEXT, width))), "emb": list(range(TEXT, width)), "all": None}
    got = cross_validated(group_folds(rows, "grp", FOLDS, by=["silo"]), ["silo"], {k: v for k, v in sets.items() if v != []})
    return auc_by(got.withColumnRenamed("set", "variant"), "variant", "silo")


def staged(rows: DataFrame, draws: int = 200) -> DataFrame:
    """stage, silo, auc, sd or bounds: folds of the development part, the fit on all of it, and the held-out part with a bootstrap interval.

    The first of five grouped folds is held out; silo "" is all.
    """
    outer = held(group_folds(rows, "grp", 5, "outer").withColumnRenamed("fold", "outer"), "outer")
    inner = held(group_folds(outer.where("outer <> 0"), "grp", 5, "inner"), "inner")
    parts = inner.select(_key(F.lit("dev"), "fold").alias("cell"), F.col("paper_id").alias("id"), "y", "x").union(outer.where("outer = 0").select(F.lit("test"), "paper_id", "y", "x"))
    packed = manymodels.blocks(parts)
    cells = held(packed.select("cell").distinct(), "cells")
    models = cells.where("cell <> 'test'").select(F.col("cell").alias("model")).union(rows.sparkSession.createDataFrame([("whole",)], "model string"))
    models = held(models.withColumn("c", F.lit(1.0)).withColumn("cols", _numbers(None)), "designs")
    pairs = held(models.select("model").join(F.broadcast(cells)), "pairs")  # six models, six cells
    state = manymodels.fit(packed, models, pairs.where("cell <> 'test' and model <> cell"))
    got = held(manymodels.scores(packed, state, pairs.where("model = cell or model = 'whole'")), "scored")
    test = held(got.where("model = 'whole'").join(outer.where("outer = 0").select(F.col("paper_id").alias("id"), F.col("silo").cast("string").alias("silo")), "id").select("id", "silo", "y", "score"), "test")
    none = F.lit(None).cast("double")
    validate = auc_by(got.where("model <> 'whole'"), "model").agg(F.avg("auc").alias("auc"), F.stddev_pop("auc").alias("sd")).select(F.lit("validate").alias("stage"), F.lit("").alias("silo"), "auc", "sd", none.alias("lo"), none.alias("hi"))
    fitted = auc_by(got.where("model = 'whole'").join(inner.select(F.col("paper_id").alias("id")), "id"), "model").select(F.lit("train"), F.lit(""), "auc", none, none, none)
    whole = resampling.auc_interval(test.select(F.lit("").alias("silo"), "y", F.col("score").alias("s")), draws).select(F.lit("test"), "silo", "auc", none, "lo", "hi")
    return validate.union(fitted).union(whole).union(auc_by(test, "silo").select(F.lit("test"), "silo", "auc", none, none, none))


def combined_pool(tables: list[DataFrame], folds: int = FOLDS) -> DataFrame:
    """paper_id, y, stack, pred over the union of labelled tables on the columns that all have: out-of-fold branches, stacked."""
    common = [c for c in tables[0].columns if all(c in t.columns for t in tables[1:])]
    numbers = [c for c in common if c.startswith("f_")]
    pool = None
    for t in tables:
        part = t.select("paper_id", "grp", "y", F.array(*[F.col(c).cast("double") for c in numbers]).alias("x"), F.lit("pool").alias("silo"))
        pool = part if pool is None else pool.union(part)
    half = max(1, len(numbers) // 2)
    return stacked(pool, folds, {"first": list(range(half)), "second": list(range(half, len(numbers))) or [0], "all": list(range(len(numbers)))})


def labelled_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, silo (lang), grp, y, x (text measures, then the whole embedding, null where there is no vector), floor_score."""
    from .modelling import FEATURES, features, prepare_dataset

    docs, labels, vectors = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels", "embeddings"))
    rows = features(docs, labels).drop("lang", "y", "fold").join(prepare_dataset(docs, labels), "doc_id").join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0  # the widest vector; shorter ones lack their last components
    x = F.array(*[F.col(c) for c in FEATURES], *[F.try_element_at("embedding", F.lit(i + 1)).cast("double") for i in range(width)])
    return held(rows.select(F.col("doc_id").alias("paper_id"), "silo", "grp", "y", x.alias("x"), (F.col("share_marks") * 20 + F.pmod(F.col("doc_id"), F.lit(7)) / 70).alias("floor_score")), "labelled")


def _scored(spark, sf_dir):
    from ..plans.catalogue import CATALOGUE

    return CATALOGUE.view_frame(spark, "scored", lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))


def _wide(spark, sf_dir) -> list[DataFrame]:
    rows = labelled_table(spark, sf_dir)
    wide = rows.select("paper_id", "silo", "grp", "y", *[F.col("x")[i].alias(f"f_{i:02d}") for i in range(_width(rows))])
    return [wide.where("silo = 'en'"), wide.where("silo <> 'en'").drop("f_07").withColumn("f_extra", F.lit(1.0))]


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _ordered(rows: DataFrame) -> DataFrame:
    """doc_id, lang, y, score: whole groups to five folds, each scored by the trees of the others."""
    rows = held(group_folds(rows, "grp", FOLDS), "folded")
    got = ordered_gbt(rows.select(F.col("paper_id").alias("id"), "fold", "y", "x"), FOLDS)
    return got.join(rows.select(F.col("paper_id").alias("id"), F.col("silo").alias("lang")), "id").select(F.col("id").alias("doc_id"), "lang", "y", "score")


QUERIES = {
    "gbt": lambda s, d: _ordered(labelled_table(s, d)),
    "oof_proba": lambda s, d: _rounded(within_silo_oof(labelled_table(s, d), seeds=1)), "cv_roc_auc": lambda s, d: cv_summary(within_silo_oof(labelled_table(s, d))),
    "within_silo_cv": lambda s, d: seed_summary(within_silo_oof(labelled_table(s, d))), "within_review_cv": lambda s, d: seed_summary(within_silo_oof(labelled_table(s, d), groups=False)),
    "shuffled_label_sanity": lambda s, d: seed_summary(within_silo_oof(labelled_table(s, d), shuffled=True)), "warm_start_budgets": lambda s, d: warm_start(labelled_table(s, d)),
    "label_budget_grid": lambda s, d: label_budgets(labelled_table(s, d)), "induced_low_label": lambda s, d: _rounded(induced_low_label(labelled_table(s, d))), "stack_meta": lambda s, d: _rounded(stacked(labelled_table(s, d))),
    "calibrate": lambda s, d: _rounded(calibrated(labelled_table(s, d))), "hparam_search": lambda s, d: hparam_search(labelled_table(s, d)), "model_column_sets": lambda s, d: column_sets(labelled_table(s, d)),
    "staged_evaluate": lambda s, d: _rounded(staged(labelled_table(s, d))), "combined_pool_stack": lambda s, d: _rounded(combined_pool(_wide(s, d))), "bootstrap_auc_ci": lambda s, d: _rounded(resampling.auc_interval(_scored(s, d))),
    "paired_bootstrap": lambda s, d: _rounded(resampling.paired_bootstrap(_scored(s, d))), "spearman_ci": lambda s, d: _rounded(resampling.spearman_interval(_scored(s, d))), "bootstrap_omnibus": lambda s, d: resampling.bootstrap_omnibus(_scored(s, d)),
}
