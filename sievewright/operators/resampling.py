"""Bootstrap intervals for any number of rows and distinct scores.

A resample gives each row a Poisson(1) weight, so rows that agree in all values have a Poisson weight of their number: cells of distinct values are counted first and each
draws its weights from a generator keyed by a hash of its group and values, the same ones wherever the cell is met. Cells are dealt by ranges of the
score and walked in order, all draws at once; a task sends a group's weights and its share of the rank sums, and what lies in the tasks before is added by group. Draw 0 is the sample.
One task holds what it walks past and the ties of one score, never a group. Null scores are left out; one class gives null.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.held import held


def weights(key: int, count: int, draws: int) -> np.ndarray:
    """The cell's own number, then its weight in each draw."""
    return np.append(float(count), np.random.default_rng(key & (2**64 - 1)).poisson(count, draws))


def cells(rows: DataFrame, values: list[str], by: str = "silo") -> DataFrame:
    """``by``, ``values``, _c (rows), _k (what the draws hang on)."""
    known = rows
    for v in values:
        known = known.where(F.col(v).isNotNull())
    counted = known.groupBy(by, *values).agg(F.count("*").alias("_c"))
    return held(counted.withColumn("_k", F.xxhash64(by, *values)), "cells")


def _in_order(table: DataFrame, by: str, value: str) -> DataFrame:
    return table.repartitionByRange(by, value).sortWithinPartitions(by, value).withColumn("_task", F.spark_partition_id())


def _runs(batches, by: str, value: str) -> Iterator[tuple]:
    """(group, task, rows of one value) one after the other; rows are dictionaries."""
    rows = (r for batch in batches for r in batch.to_pylist())
    for (group, _), run in itertools.groupby(rows, key=lambda r: (r[by], r[value])):
        first = next(run)
        yield group, first["_task"], itertools.chain([first], run)


def _binary(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    kinds = [pa.string(), pa.int32()] + [pa.binary()] * (len(names) - 2)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def auc_draws(table: DataFrame, value: str, draws: int, by: str = "silo") -> DataFrame:
    """``by``, aucs: tie-aware AUC of the sample and of every draw; ``table`` holds cells with y. NaN where a draw has one class."""
    parts = [by, "task", "share", "pos", "neg"]

    def walk(batches):
        out = {}
        for group, task, run in _runs(batches, by, value):
            pos, neg = np.zeros(draws + 1), np.zeros(draws + 1)
            for r in run:
                (pos if r["y"] == 1 else neg).__iadd__(weights(r["_k"], r["_c"], draws))
            share, before_pos, before_neg, _ = out.get(group) or (0.0, 0.0, 0.0, task)
            out[group] = share + pos * (before_neg + neg / 2), before_pos + pos, before_neg + neg, task
        yield _binary(parts, [(g, t, s.tobytes(), p.tobytes(), n.tobytes()) for g, (s, p, n, t) in out.items()])

    def total(found: pa.Table) -> pa.Table:
        rows = sorted(found.to_pylist(), key=lambda r: r["task"])
        share, pos, neg = np.zeros(draws + 1), np.zeros(draws + 1), np.zeros(draws + 1)
        for r in rows:
            p = np.frombuffer(r["pos"])
            share, pos, neg = share + np.frombuffer(r["share"]) + p * neg, pos + p, neg + np.frombuffer(r["neg"])
        pairs = pos * neg
        auc = np.divide(share, pairs, out=np.full(draws + 1, np.nan), where=pairs > 0)
        return pa.table([pa.array([rows[0][by]], pa.string()), pa.array([float(pos[0] + neg[0])]), pa.array([auc.tolist()], pa.list_(pa.float64()))], names=[by, "n", "aucs"])

    dealt = _in_order(table.select(F.col(by).cast("string").alias(by), value, "y", "_c", "_k"), by, value)
    sums = held(dealt.mapInArrow(walk, f"{by} string, task int, share binary, pos binary, neg binary"), "shares")
    return sums.groupBy(by).applyInArrow(total, f"{by} string, n double, aucs array<double>")


def _interval(v: np.ndarray) -> tuple[float, float]:
    v = v[~np.isnan(v)]
    return tuple(map(float, np.percentile(v, [2.5, 97.5]))) if len(v) else (None, None)


def _each(frame: DataFrame, row: Callable[[pd.Series], tuple], schema: str) -> DataFrame:
    """``row`` of every row of a table with a row a group."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(parts):
        for f in parts:
            made = pd.DataFrame([row(r) for r in f.itertuples(index=False)], columns=names)
            yield made.astype({n: float for n, t in (x.split() for x in schema.split(", ")) if t == "double"})

    return frame.mapInPandas(run, schema)


def _or_none(x):
    return None if x is None or np.isnan(x) else float(x)


def auc_interval(rows: DataFrame, draws: int = 200) -> DataFrame:
    """silo, AUC of s for y, and the bounds of 95% of the draws."""
    got = auc_draws(cells(rows, ["s", "y"]), "s", draws)
    return _each(got, lambda r: (r.silo, _or_none(r.aucs[0]), *_interval(np.asarray(r.aucs)[1:])), "silo string, auc double, lo double, hi double")


def paired_bootstrap(rows: DataFrame, draws: int = 400) -> DataFrame:
    """silo, AUC of s less AUC of s2 on the same resamples, interval, p = twice the smaller tail, at most 1."""
    table = cells(rows, ["s", "s2", "y"])
    both = auc_draws(table, "s", draws).join(auc_draws(table, "s2", draws).select("silo", F.col("aucs").alias("others")), "silo")

    def one(r):
        d = np.asarray(r.aucs) - np.asarray(r.others)
        v = d[1:][~np.isnan(d[1:])]
        return r.silo, _or_none(d[0]), *_interval(v), min(1.0, 2 * min((v <= 0).mean(), (v >= 0).mean())) if len(v) else None

    return _each(both, one, "silo string, delta double, lo double, hi double, p double")


def bootstrap_omnibus(rows: DataFrame, draws: int = 400) -> DataFrame:
    """n_silos, stat, p: the n-weighted spread of the silos' AUCs against resamples of each silo, recentred on its own AUC."""
    got = auc_draws(cells(rows, ["s", "y"]), "s", draws).where(~F.isnan(F.get("aucs", F.lit(0))))
    each = held(got.select("silo", "n", F.get("aucs", F.lit(0)).alias("own"), F.posexplode("aucs").alias("draw", "a")), "draws")
    moved = each.withColumn("v", F.when(F.col("draw") == 0, F.col("own")).otherwise(F.when(F.isnan("a"), F.lit(0.0)).otherwise(F.col("a") - F.col("own"))))
    means = moved.groupBy("draw").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("mean"))
    spread = moved.join(means, "draw").groupBy("draw").agg(F.sum(F.col("n") * F.pow(F.col("v") - F.col("mean"), 2)).alias("spread"), F.count("*").alias("k"))
    stat = F.max(F.when(F.col("draw") == 0, F.col("spread")))
    out = spread.agg(F.max("k").alias("k"), stat.alias("stat"), F.collect_list(F.when(F.col("draw") > 0, F.col("spread"))).alias("null"))  # a number a draw
    share = F.aggregate("null", F.lit(0.0), lambda a, x: a + F.when(x >= F.col("stat"), 1.0).otherwise(0.0)) / F.size("null")
    return out.select(F.coalesce(F.col("k"), F.lit(0)).cast("int").alias("n_silos"), F.round("stat", 6).alias("stat"), F.when(F.size("null") > 0, share).alias("p"))


def spearman_interval(rows: DataFrame, draws: int = 200) -> DataFrame:
    """silo, rank correlation of s and s2 with average ranks, and its interval."""
    table = cells(rows, ["s", "s2"]).select(F.col("silo").cast("string").alias("silo"), "s", "s2", "_c", "_k")

    def packed(rows):
        kinds = (pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        columns = list(zip(*rows)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["silo", "task", "s2", "_c", "_k", "rank", "upto"])

    def ranks(batches):
        """Every cell with the rank of its s among the task's own, in all draws; at the end a row for each group with the weights of all its cells here."""
        before, out, task = {}, [], None
        for group, task, run in _runs(batches, "silo", "s"):
            run = list(run)  # the ties of one score
            tie = np.sum([weights(r["_k"], r["_c"], draws) for r in run], axis=0)
            done = before.get(group, np.zeros(draws + 1))
            rank = (done + (tie + 1) / 2).tobytes()
            before[group] = done + tie
            out += [(group, task, r["s2"], r["_c"], r["_k"], rank, None) for r in run]
            if len(out) > 2000:
                yield packed(out)
                out = []
        yield packed(out + [(g, task, None, None, None, None, v.tobytes()) for g, v in before.items()])

    numbers = table.withColumn("s", F.col("s").cast("double")).withColumn("s2", F.col("s2").cast("double"))
    first = held(_in_order(numbers, "silo", "s").mapInArrow(ranks, "silo string, task int, s2 double, _c long, _k long, rank binary, upto binary"), "ranks")

    def before(found: pa.Table) -> pa.Table:
        """What lies in the tasks before each."""
        out, done = [], np.zeros(draws + 1)
        for r in sorted(found.to_pylist(), key=lambda r: r["task"]):
            out.append((r["silo"], r["task"], done.tobytes()))
            done = done + np.frombuffer(r["upto"])
        return pa.Table.from_batches([_binary(["silo", "task", "below"], out)])

    ends = first.where("upto is not null").select("silo", "task", "upto")  # a row a task and group
    offsets = held(ends.groupBy("silo").applyInArrow(before, "silo string, task int, below binary"), "offsets")
    second = first.where("upto is null").drop("upto").join(offsets, ["silo", "task"]).drop("task")
    sums = ["silo", "task", "w", "x", "xx", "y", "yy", "xy"]

    def walk(batches):
        out: dict = {}
        for group, task, run in _runs(batches, "silo", "s2"):
            tie, x, xx = np.zeros(draws + 1), np.zeros(draws + 1), np.zeros(draws + 1)
            for r in run:
                w, rank = weights(r["_k"], r["_c"], draws), np.frombuffer(r["rank"]) + np.frombuffer(r["below"])
                tie, x, xx = tie + w, x + w * rank, xx + w * rank * rank
            acc = out.setdefault(group, [task, *[np.zeros(draws + 1) for _ in range(6)]])
            y = acc[1] + (tie + 1) / 2
            for i, v in enumerate((tie, x, xx, tie * y, tie * y * y, x * y)):
                acc[i + 1] = acc[i + 1] + v
        yield _binary(sums, [(g, a[0], *[v.tobytes() for v in a[1:]]) for g, a in out.items()])

    def total(found: pa.Table) -> pa.Table:
        rows = sorted(found.to_pylist(), key=lambda r: r["task"])
        acc = {k: np.zeros(draws + 1) for k in sums[2:]}
        for r in rows:
            p, up = {k: np.frombuffer(r[k]) for k in sums[2:]}, acc["w"].copy()
            add = {"w": p["w"], "x": p["x"], "xx": p["xx"], "y": p["y"] + up * p["w"], "yy": p["yy"] + 2 * up * p["y"] + up * up * p["w"], "xy": p["xy"] + up * p["x"]}
            acc = {k: acc[k] + add[k] for k in acc}
        n = np.maximum(acc["w"], 1e-300)
        cov, vx, vy = acc["xy"] - acc["x"] * acc["y"] / n, acc["xx"] - acc["x"] ** 2 / n, acc["yy"] - acc["y"] ** 2 / n
        d = np.sqrt(np.maximum(vx, 0) * np.maximum(vy, 0))
        rho = np.divide(cov, d, out=np.full(draws + 1, np.nan), where=d > 1e-9 * np.maximum(1, n))
        return pa.table([pa.array([rows[0]["silo"]], pa.string()), pa.array([rho.tolist()], pa.list_(pa.float64()))], names=["silo", "rhos"])

    parts = held(_in_order(second, "silo", "s2").mapInArrow(walk, "silo string, task int, " + ", ".join(f"{k} binary" for k in sums[2:])), "products")
    got = parts.groupBy("silo").applyInArrow(total, "silo string, rhos array<double>")
    return _each(got, lambda r: (r.silo, _or_none(r.rhos[0]), *_interval(np.asarray(r.rhos)[1:])), "silo string, rho double, lo double, hi double")

