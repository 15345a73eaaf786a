"""Centroid clustering by annulus search, in exact integers.

Vectors become integers floor(scale * x). A round sorts the centroids by norm. Each vector has an upper bound on its distance to the
nearest centroid: its distance to the centroid whose norm is next to its own. By the triangle inequality the nearest one's norm lies within that
bound of the vector's norm; a binary search of the norms gives this annulus (widened by what rounding could hide, its borders included),
and only the centroids in it are compared, squared Euclidean distances in whole numbers, the smaller number winning a tie.

A round is one pass over the vectors: a partition adds up its vectors by centroid and sends the sums alone, so no centroid's vectors
meet in one task, however many it has. ``k`` centroids of ``d`` components, ``k`` sums of distances: nothing else is on the driver.

Distances come from products in double precision where all are whole numbers below 2^53 (components up to ``EXACT``), else from Python's integers; a distance
or inertia over 2^63 - 1 is given as that. Vectors that are null, of another length, or hold null or non-finite components are left out. A null vec_id
hashes last; rows that repeat a vec_id are vectors of their own; equal hashes are ordered by components; fewer vectors than ``k`` give as many
centroids; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

K, ROUNDS, SCALE, SIZE, SALT, EXACT, LIMB, MOST = 16, 3, 64, 64, "1:", 1 << 22, 60, 2**63 - 1


def whole(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): doubles where the results are small, else Python integers."""
    out = np.floor(scale * flat) if not flat.size or np.abs(flat).max() < 2.0**40 else None
    if out is not None and (not out.size or np.abs(out).max() <= EXACT):
        return out
    return np.array([math.floor(scale * int(x)) if abs(x) >= 2.0**60 else math.floor(scale * x) for x in flat.ravel().tolist()], object).reshape(flat.shape)


def nearest(vectors: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector, the squared distances, and how many were compared."""
    small = vectors.dtype != object and all(abs(x) <= EXACT for c in centroids for x in c)
    v = vectors if small else np.array([[int(x) for x in row] for row in vectors.tolist()], object).reshape(len(vectors), -1)
    c = np.array(centroids, np.float64 if small else object)
    vv, cc = (v * v).sum(axis=1), (c * c).sum(axis=1)
    root = np.sqrt if small else np.vectorize(math.isqrt, otypes=[object])
    norms, mine = root(cc), root(vv)
    order = np.lexsort((np.arange(len(c)), norms)) if small else np.array(sorted(range(len(c)), key=lambda i: (norms[i], i)))
    ring = norms[order]

    def apart(rows, j):
        return vv[rows] + cc[j] - 2 * (v[rows] @ c[j])

    at = np.clip(np.searchsorted(ring, mine), 0, len(c) - 1)
    left = np.maximum(at - 1, 0)
    first = order[np.where(np.abs(ring[left] - mine) < np.abs(ring[at] - mine), left, at)]
    best, found, compared = np.zeros(len(v), v.dtype), first.copy(), len(v)
    for j in np.unique(first):
        rows = np.flatnonzero(first == j)
        best[rows] = apart(rows, j)
    bound = root(best)
    slack = (bound + mine + ring[-1]) * 1e-9 + 1 if small else 4  # what rounding, or roots cut to integers, may hide
    low, high = np.searchsorted(ring, mine - bound - slack, "left"), np.searchsorted(ring, mine + bound + slack, "right")
    for p, j in enumerate(order.tolist()):
        rows = np.flatnonzero((low <= p) & (p < high) & (first != j))
        if len(rows):
            compared += len(rows)
            d = apart(rows, j)
            win = (d < best[rows]) | ((d == best[rows]) & (j < found[rows]))
            best[rows[win]], found[rows[win]] = d[win], j
    return found, best, compared


def _vectors(batch: pa.RecordBatch, size: int, scale: int) -> np.ndarray:
    column = batch.column("v")
    return whole(np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), size), scale)


def _sums(centroids: list[list[int]], size: int, scale: int):
    """For each centroid: its vectors' number (at = -1) and componentwise sums, in limbs of 2^60, one set a partition."""

    def run(batches):
        totals = [[0] * (size + 1) for _ in centroids]
        for batch in batches:
            if batch.num_rows:
                v = _vectors(batch, size, scale)
                found = nearest(v, centroids)[0]
                for j in np.unique(found).tolist():
                    part = v[found == j]
                    add = [len(part), *(int(x) for x in part.sum(axis=0))]
                    totals[j] = [a + b for a, b in zip(totals[j], add)]
        rows = []
        for j, line in enumerate(totals):
            for i, x in enumerate(line):
                limb, sign = 0, -1 if x < 0 else 1
                x = abs(x)
                while x:
                    rows.append((j, i - 1, limb, sign * (x & ((1 << LIMB) - 1))))
                    x, limb = x >> LIMB, limb + 1
        columns = list(zip(*rows)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["cluster", "at", "limb", "part"])

    return run


def _assigned(centroids: list[list[int]], size: int, scale: int):
    def run(batches):
        for batch in batches:
            found, best = (nearest(_vectors(batch, size, scale), centroids)[:2]) if batch.num_rows else ((), ())
            distance = pa.array([min(int(x), MOST) for x in best], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(found, pa.int32()), distance], ["vec_id", "cluster", "distance"])

    return run


def moved(centroids: list[list[int]], sums) -> list[list[int]]:
    """Componentwise floor(sum / count); a centroid without vectors stays."""
    totals = [[0] * (len(c) + 1) for c in centroids]
    for r in sums:
        totals[r["cluster"]][r["at"] + 1] += int(r["part"]) << (LIMB * r["limb"])
    return [[x // n for x in line] if n else c for c, (n, *line) in zip(centroids, totals)]


def clusters(rows: DataFrame, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, size: int = SIZE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector of ``size`` finite components in ``rows`` (vec_id, embedding)."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "annulus")
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(v.isNotNull() & (F.size(v) == size) & finite)
    digest = F.sha2(F.concat(F.lit(SALT), F.col("vec_id").cast("string")), 256)
    seeds = kept.orderBy(digest.asc_nulls_last(), "v").limit(k).select("v").collect()  # k vectors
    centroids = [[int(x) for x in whole(np.array(r["v"], np.float64), scale).tolist()] for r in seeds]
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        sums = kept.select("v").mapInArrow(_sums(centroids, size, scale), "cluster int, at int, limb int, part long")
        sums = sums.groupBy("cluster", "at", "limb").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part"))
        centroids = moved(centroids, sums.collect())  # k x (size + 1) numbers
    placed = scratch.save(kept.mapInArrow(_assigned(centroids, size, scale), "vec_id long, cluster int, distance long"), "placed")
    inertia = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # at most k rows
    total = min(sum(inertia.values()), MOST)
    facts = [(j, min(inertia.get(j, 0), MOST), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, centroid_sha256 string")
    out = placed.join(F.broadcast(facts), "cluster")  # k rows
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256")
