"""Boosted oblivious trees on permutation-ordered residuals, over distributed histograms.

Rows stand in one seeded order. Besides the model of all training rows there is one for every prefix of 1, 2, 4, ... rows of it, with the same trees and leaf values of its
own; the residual that the trees' splits are chosen by comes from the largest prefix that ends before the row, so a row's own label never enters its residual. A tree is
grown a level at a time: every task adds up gradients and Hessians of its rows by leaf, column and bin, the sums (leaves x columns x bins, whatever the rows)
meet by model, and one split is taken for the whole level. Missing values are a bin of their own, which a split may set apart. Borders are quantiles of a model's
training rows. All folds grow in the same passes, a model each.

Rows are packed into blocks of bins and of each model's predictions; the tables are written every few trees, and in between a pass applies the trees since then
first. The driver holds trees and sums of histograms only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.held import held
from .folds import draw_order

TREES, DEPTH, RATE, PENALTY, BINS, EVERY, SALTS = 20, 3, 0.1, 3.0, 32, 5, 32
BLOCK = "fold int, ids binary, y binary, place binary, bins binary, state binary"


@dataclass
class Tree:
    """For each model: the (column, bin) of every level, and leaf values by model of a prefix, the last one that of all rows."""

    splits: list[list[tuple[int, int]]]
    values: np.ndarray


def sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -35, 35)))


def leaves(bins: np.ndarray, splits: list[tuple[int, int]]) -> np.ndarray:
    """A row's leaf: bit i is set where its bin lies above the i-th split."""
    out = np.zeros(len(bins), np.int64)
    for i, (column, cut) in enumerate(splits):
        out |= (bins[:, column] > cut).astype(np.int64) << i
    return out


def level_of(place: np.ndarray) -> np.ndarray:
    """The largest prefix that ends before the row: 2^level <= place; -1 for the first row."""
    return np.floor(np.log2(np.maximum(place, 0.5))).astype(np.int64)


class Block:
    """Rows of one fold with their bins and predictions in every model: state[model, prefix, row]."""

    def __init__(self, batch: pa.RecordBatch, i: int, models: int, levels: int):
        get = lambda name: batch.column(name)[i].as_py()
        self.fold, self.ids, self.y, self.place = get("fold"), np.frombuffer(get("ids"), np.int64), np.frombuffer(get("y")), np.frombuffer(get("place"), np.int64)
        n = len(self.y)
        self.bins = np.frombuffer(get("bins"), np.uint8).reshape(models, n, -1)
        self.state = np.frombuffer(get("state")).reshape(models, levels + 1, n).copy()

    def apply(self, trees: list[Tree], rate: float) -> Block:
        for tree in trees:
            for m, splits in enumerate(tree.splits):
                self.state[m] += rate * tree.values[m][:, leaves(self.bins[m], splits)]
        return self

    def learns(self, m: int) -> bool:
        return self.fold != m

    def gradient(self, m: int, f: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, w = sigmoid(f), weights[m][self.y.astype(int)]
        return w * (self.y - p), w * p * (1 - p)

    def ordered(self, m: int) -> np.ndarray:
        """Each row's prediction by the prefix before it."""
        at = level_of(self.place)
        return np.where(at >= 0, self.state[m][np.maximum(at, 0), np.arange(len(at))], 0.0)


def _sums(work):
    """``work(block)`` yields (model, array); arrays are added up within the partition."""

    def run(batches):
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for m, a in work(batch):
                out[m] = out[m] + a if m in out else a
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([a.tobytes() for a in out.values()], pa.binary())], ["model", "sums"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, model = 0.0, None
    for batch in batches:
        for i in range(batch.num_rows):
            model, total = batch.column("model")[i].as_py(), total + np.frombuffer(batch.column("sums")[i].as_py())
    yield pa.RecordBatch.from_arrays([pa.array([model], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["model", "sums"])


def best_split(hist: np.ndarray, penalty: float) -> tuple[int, int]:
    """The (column, bin) with the largest sum of squared gradients over Hessians of both sides, over all leaves; ties: the first. hist: leaf, column, bin, (g, h)."""
    left = hist.cumsum(axis=2)
    total = left[:, :, -1:, :]
    right = total - left
    gain = (left[..., 0] ** 2 / (left[..., 1] + penalty) + right[..., 0] ** 2 / (right[..., 1] + penalty)).sum(axis=0)
    return tuple(int(v) for v in np.unravel_index(np.argmax(np.round(gain, 9)), gain.shape))


class OrderedBoosting:
    """One model for each fold, of the rows of all other folds."""

    def __init__(self, folds: int, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, penalty: float = PENALTY, bins: int = BINS):
        self.models, self.n_trees, self.depth, self.rate, self.penalty, self.n_bins = folds, trees, depth, rate, penalty, min(bins, 255)
        self.trees: list[Tree] = []

    def _borders(self, rows: DataFrame, width: int) -> np.ndarray:
        """Quantiles by model and column (models x width x bins - 2, sorted; equal ones leave bins empty)."""
        shares = [(i + 1) / (self.n_bins - 1) for i in range(self.n_bins - 2)]
        model = F.explode(F.sequence(F.lit(0), F.lit(self.models - 1))).alias("model")
        long = rows.select("fold", "x", model).where("model <> fold").select("model", F.posexplode("x").alias("at", "v")).where("v is not null")
        got = long.groupBy("model", "at").agg(F.percentile_approx("v", shares, 10000).alias("q")).collect()  # models x columns
        out = np.full((self.models, width, self.n_bins - 2), np.inf)
        for r in got:
            out[r["model"], r["at"]] = r["q"]
        return out

    def _packed(self, rows: DataFrame, borders: np.ndarray) -> DataFrame:
        models, levels = self.models, self.levels

        def pack(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                fold = batch.column("fold").to_numpy(zero_copy_only=False)
                x = np.asarray(batch.column("x").flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1)
                ids, place, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "place", "y"))
                out = []
                for k in np.unique(fold):
                    at = np.flatnonzero(fold == k)
                    bins = np.zeros((models, len(at), x.shape[1]), np.uint8)
                    for m in range(models):
                        for j in range(x.shape[1]):
                            v = x[at, j]
                            bins[m, :, j] = np.where(np.isnan(v), 0, np.searchsorted(borders[m, j], v, side="left") + 1)
                    out.append((int(k), ids[at].astype(np.int64).tobytes(), y[at].astype(float).tobytes(), place[at].astype(np.int64).tobytes(), bins.tobytes(), np.zeros((models, levels + 1, len(at))).tobytes()))
                yield _rows(out)

        dealt = rows.repartition(F.pmod(F.xxhash64("id"), F.lit(SALTS)), "fold")
        return held(dealt.select("fold", "id", "place", "y", "x").mapInArrow(pack, BLOCK), "boosting")

    def fit(self, rows: DataFrame) -> DataFrame:
        """Grows the trees on ``rows`` (id, fold, y, x: numbers, null where missing); gives id, fold, y, score of every row by its own fold's model."""
        rows = held(draw_order(rows.select(F.col("id").cast("long").alias("id"), F.col("fold").cast("int").alias("fold"), F.col("y").cast("int").alias("y"), "x").withColumn("_all", F.lit(0)), ["_all"], "id", "ordered", "place"), "ordered")
        n, width = rows.agg(F.max("place") + 1, F.max(F.size("x"))).first()
        counts = {(r["fold"], r["y"]): r["count"] for r in rows.groupBy("fold", "y").count().collect()}  # two a fold
        if not n:
            return rows.select("id", "fold", "y", F.lit(None).cast("double").alias("score"))
        self.levels = int(level_of(np.array([max(1, n - 1)]))[0]) + 1
        weights = np.ones((self.models, 2))
        for m in range(self.models):
            c = [sum(v for (f, y), v in counts.items() if f != m and y == k) for k in (0, 1)]
            weights[m] = [sum(c) / (2 * max(1, k)) for k in c]
        blocks, pending = self._packed(rows, self._borders(rows, width)), []
        models, levels, depth, bins, rate = self.models, self.levels, self.depth, self.n_bins, self.rate

        def summed(work) -> dict[int, np.ndarray]:
            got = blocks.mapInArrow(_sums(work), "model int, sums binary").groupBy("model").applyInArrow(_add, "model int, sums binary").collect()  # a row a model
            return {r["model"]: np.frombuffer(r["sums"]) for r in got}

        for _ in range(self.n_trees):
            splits: list[list[tuple[int, int]]] = [[] for _ in range(models)]
            for level in range(depth):

                def histograms(batch, trees=tuple(pending), now=tuple(map(tuple, splits)), level=level):
                    for i in range(batch.num_rows):
                        b = Block(batch, i, models, levels).apply(list(trees), rate)
                        for m in range(models):
                            if b.learns(m):
                                g, h = b.gradient(m, b.ordered(m), weights)
                                at = ((leaves(b.bins[m], list(now[m]))[:, None] * width + np.arange(width)) * bins + b.bins[m]).ravel()
                                yield m, np.stack([np.bincount(at, np.repeat(v, width), (1 << level) * width * bins) for v in (g, h)], 1).ravel()

                for m, s in summed(histograms).items():
                    splits[m].append(best_split(s.reshape(1 << level, width, bins, 2), self.penalty))

            def leaf_sums(batch, trees=tuple(pending), now=tuple(map(tuple, splits))):
                for i in range(batch.num_rows):
                    b = Block(batch, i, models, levels).apply(list(trees), rate)
                    for m in range(models):
                        if b.learns(m):
                            at, out = leaves(b.bins[m], list(now[m])), np.zeros((levels + 1, 1 << depth, 2))
                            for j in range(levels + 1):
                                inside = b.place < (1 << j) if j < levels else np.ones(len(at), bool)
                                for c, v in enumerate(b.gradient(m, b.state[m, j], weights)):
                                    out[j, :, c] = np.bincount(at[inside], v[inside], 1 << depth)
                            yield m, out.ravel()

            values = np.zeros((models, levels + 1, 1 << depth))
            for m, s in summed(leaf_sums).items():
                s = s.reshape(levels + 1, 1 << depth, 2)
                values[m] = s[..., 0] / (s[..., 1] + self.penalty)
            tree = Tree(splits, values)
            self.trees.append(tree)
            pending.append(tree)
            if len(pending) == EVERY:
                blocks, pending = held(blocks.mapInArrow(self._applied(pending), BLOCK), "boosting"), []
        return blocks.mapInArrow(self._scores(pending), "id long, fold int, y int, score double")

    def _applied(self, trees):
        models, levels, rate = self.models, self.levels, self.rate

        def run(batches):
            for batch in batches:
                state = [Block(batch, i, models, levels).apply(trees, rate).state.tobytes() for i in range(batch.num_rows)]
                yield batch.set_column(batch.schema.get_field_index("state"), "state", pa.array(state, pa.binary()))

        return run

    def _scores(self, trees):
        models, levels, rate = self.models, self.levels, self.rate

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    b = Block(batch, i, models, levels).apply(trees, rate)
                    s = sigmoid(b.state[b.fold, -1])
                    yield pa.RecordBatch.from_arrays([pa.array(b.ids), pa.array([b.fold] * len(s), pa.int32()), pa.array(b.y.astype(int), pa.int32()), pa.array(s)], ["id", "fold", "y", "score"])

        return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.binary()] * 5))], ["fold", "ids", "y", "place", "bins", "state"])


def ordered_gbt(rows: DataFrame, folds: int = 5, **how) -> DataFrame:
    """id, fold, y, score: every row of (id, fold, y, x) scored by the trees of the other folds."""
    return OrderedBoosting(folds, **how).fit(rows)
