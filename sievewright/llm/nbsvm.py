"""Quality classifier: naive Bayes support vectors.

A text's features are the indicators of the byte trigrams, of the word shapes' n-grams that occur
in it, of a word bigram that repeats one word and of the share of distinct words, hashed to ``BUCKETS``; each is scaled by its class log-count ratio and the
row brought to unit length. A linear hinge-loss model (squared hinge, L2) is fitted by dual
coordinate descent, then its margins are calibrated by a logistic curve.

The fit takes at most ``FIT_ROWS`` labelled rows of each class, those whose hashed doc_id is lowest
(a documented bound; equal texts count once). Scoring takes every row, over its whole text.

Null text counts as empty and gets a score like any other; a null doc_id counts as remainder 0 of
its empty id text; labels that repeat a doc_id or are null are averaged or ignored; of rows that repeat a labelled doc_id the text of lowest
hash is learned from, and all are scored, equal rows alike; with labels of one class or none every row scores 0.5 if nothing is known, else
near that class; an empty table gives no rows; texts are read whole, one at a time; other columns are ignored, and kept by ``keep_good``.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes

BUCKETS, FIT_ROWS, THRESHOLD = 1 << 17, 3000, 0.7
HELD_OUT, FOLDS = 2, 4
_SHIFT = np.uint32(32 - 17)
#: Byte classes for shapes: 0 white space, 1 lower, 2 upper, 3 digit, 4 other ASCII, 5 beyond ASCII.
_CLASS = np.array([0 if c == 32 or 9 <= c <= 13 else 1 if 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4 if c < 128 else 5 for c in range(256)], np.uint32)


class Indicators:
    """Distinct feature buckets of a text, in time and memory linear in its length."""

    def __init__(self):
        self.last = np.zeros(BUCKETS, np.int64)

    def __call__(self, text: bytes) -> np.ndarray:
        b = np.frombuffer(b" " + text + b" ", np.uint8)
        c = b.astype(np.uint32)
        tri = c[:-2] | c[1:-1] << np.uint32(8) | c[2:] << np.uint32(16)
        shape = _CLASS[b]
        shape = shape[np.flatnonzero(np.concatenate(([True], shape[1:] != shape[:-1])))]
        gram = shape.copy()
        for k in range(1, 6):  # six shapes: about two words
            gram[:-k] |= shape[k:] << np.uint32(3 * k)
        gram = gram[: max(1, len(gram) - 5)] | np.uint32(1 << 25)
        words = text.split()
        n, twice = len(words), any(map(operator.eq, words, words[1:]))
        spread = np.array([1 << 26 | min(15, n.bit_length()) << 8 | (20 * len(set(words)) // n if n else 0), 1 << 27 | twice], np.uint32)
        codes = (np.concatenate((tri, gram, spread)) * np.uint32(2654435761)) >> _SHIFT
        order = np.arange(len(codes))
        self.last[codes] = order
        return codes[self.last[codes] == order].astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray  # log-count ratio times hinge weight
    bias: float
    slope: float
    offset: float

    def score(self, features: np.ndarray) -> float:
        m = float(self.weights[features].sum()) / np.sqrt(max(1, len(features))) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * m + self.offset, -500, 500)))


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int, epochs: int = 30, seed: int = 7) -> tuple[np.ndarray, float]:
    """L2-regularised squared hinge: one dual variable at a time, in seeded random order, bias as a feature."""
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(y))
    diagonal = 0.5 / cost
    norm = np.array([float(v @ v) for v in values]) + 1.0 + diagonal
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(y)):
            x, v = rows[i], values[i]
            g = y[i] * (w[x] @ v + bias) - 1.0 + diagonal[i] * alpha[i]
            pg = min(g, 0.0) if alpha[i] == 0 else g
            worst = max(worst, abs(pg))
            if pg:
                old, alpha[i] = alpha[i], max(0.0, alpha[i] - g / norm[i])
                step = (alpha[i] - old) * y[i]
                w[x] += step * v
                bias += step
        if worst < 1e-3:
            break
    return w, bias


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton steps with a small ridge."""
    good, bad = max(1, int((y > 0).sum())), max(1, int((y < 0).sum()))
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x, theta = np.stack([margin, np.ones_like(margin)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (p - target) + 1e-3 * theta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
        theta -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    y = np.where(np.asarray(labels) > 0.5, 1.0, -1.0)
    if len(np.unique(y)) < 2:
        return Model(np.zeros(BUCKETS), 0.0, 0.0, float(3 * y[0]) if len(y) else 0.0)
    counts = {s: np.ones(BUCKETS) for s in (1.0, -1.0)}
    for x, s in zip(rows, y, strict=True):
        counts[s][x] += 1
    ratio = np.log(counts[1.0] / counts[1.0].sum()) - np.log(counts[-1.0] / counts[-1.0].sum())
    values = [ratio[x] / np.sqrt(max(1, len(x))) for x in rows]
    cost = np.where(y > 0, 0.5 * len(y) / (y > 0).sum(), 0.5 * len(y) / (y < 0).sum())
    # margins for the curve come from halves that the fit has not seen
    part, margin = np.arange(len(y)) % 2, np.zeros(len(y))
    for side in (0, 1):
        seen = np.flatnonzero(part != side)
        if len(np.unique(y[seen])) < 2:
            return Model(np.zeros(BUCKETS), 0.0, 0.0, 0.0)
        w, b = dual_coordinate_descent([rows[i] for i in seen], [values[i] for i in seen], y[seen], cost[seen], BUCKETS)
        for i in np.flatnonzero(part == side):
            margin[i] = w[rows[i]] @ values[i] + b
    slope, offset = _platt(margin, y)
    w, b = dual_coordinate_descent(rows, values, y, cost, BUCKETS)
    return Model(w * ratio, b, slope, offset)


def remainder(doc_id="doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS


def _features(batches):
    f = Indicators()
    for batch in batches:
        rows = [f(t) for t in as_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(rows, pa.list_(pa.int32()))], names=["quality", "features"])


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Model from at most ``fit_rows`` labelled rows of each class outside the held-out fold."""
    known = labels.where("quality is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.round(F.avg("quality")).cast("double").alias("quality"))
    known = known.where(remainder("_id") != HELD_OUT)
    order = F.xxhash64(F.col("_id"))
    few = known.where("quality = 1").orderBy(order, "_id").limit(fit_rows).union(known.where("quality = 0").orderBy(order, "_id").limit(fit_rows))
    # of the bounded id table, so that the join may broadcast it
    picked = docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("_id")).select("_id", "quality", F.coalesce("text", F.lit("")).alias("text"))
    # one text for each id, so that rows that repeat an id do not add to what is collected
    picked = picked.groupBy("_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("_id", "quality", "t.text")
    got = picked.mapInArrow(_with_id, "id long, quality double, features array<int>").toPandas().sort_values("id", kind="stable")
    unique = {}
    for q, x in zip(got.quality, got.features, strict=True):
        x = np.asarray(x, np.int32)
        unique.setdefault(np.sort(x).tobytes(), (q, x))
    return fit([x for _, x in unique.values()], np.array([q for q, _ in unique.values()]))


def _with_id(batches):
    for batch in batches:
        for out in _features([batch]):
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *out.columns], names=["id", "quality", "features"])


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text) with ``score``; the model goes along with the tasks (2^17 weights)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        f, m = Indicators(), shared.value
        for batch in batches:
            out = [m.score(f(t)) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(out, pa.float64())], names=["doc_id", "text", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches):
        f, m = Indicators(), shared.value
        for batch in batches:
            out = [m.score(f(t)) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", (remainder() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the model does not reject, with their columns in their order."""
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches):
        f, m = Indicators(), shared.value
        for batch in batches:
            good = [m.score(f(t)) >= THRESHOLD for t in as_bytes(batch.column(at))]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, schema)
