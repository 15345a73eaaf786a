"""The k nearest rows by cosine, exactly: blocks of queries against blocks of rows, a bounded list per query and block, merged.

Queries and rows are dealt by hash into blocks of a bounded number; a task multiplies one block of each and keeps k rows per query, so what is shuffled back is k
rows per query and block of rows, never a row per pair. Ties of the rounded cosine go to the smaller id. Null, empty, zero and non-finite vectors and vectors of
another length than the query's are near nothing; a row is no neighbour of its own id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.held import held

QUERIES_A_BLOCK, ROWS_A_BLOCK = 1024, 8192


def _blocks(rows: DataFrame, most: int) -> int:
    return max(1, -(-rows.count() // most))


def _valid(v) -> F.Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def _units(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """ids and unit vectors by their length."""
    out: dict[int, list] = {}
    for i, v in zip(table["id"].to_pylist(), table["v"].to_pylist()):
        out.setdefault(len(v), []).append((i, v))
    made = {}
    for d, rows in out.items():
        x = np.array([v for _, v in rows], np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        made[d] = np.array([i for i, _ in rows], np.int64), x / np.linalg.norm(x, axis=1, keepdims=True)
    return made


def _best(k: int):
    def run(_, queries: pa.Table, rows: pa.Table) -> pa.Table:
        found = [[], [], []]
        both = _units(rows)
        for d, (ids, q) in _units(queries).items():
            if d not in both:
                continue
            others, v = both[d]
            c = np.round(q @ v.T, 9)
            c[ids[:, None] == others[None, :]] = -np.inf
            # the k-th largest bounds the list; of its ties the smaller ids stay
            least = np.partition(c, -k, axis=1)[:, -k] if k < c.shape[1] else np.full(len(c), -2.0)
            for i in range(len(c)):
                at = np.flatnonzero((c[i] >= least[i]) & np.isfinite(c[i]))
                at = at[np.lexsort((others[at], -c[i, at]))][:k]
                found[0] += [int(ids[i])] * len(at)
                found[1] += others[at].tolist()
                found[2] += c[i, at].tolist()
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query_id", "id", "cosine"])

    return run


def nearest(queries: DataFrame, rows: DataFrame, k: int, queries_a_block: int = QUERIES_A_BLOCK, rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """query_id, place (1 is the nearest), id, cosine (9 decimals): the ``k`` nearest of ``rows`` (id, v) for every one of ``queries`` (id, v); ids are unique."""
    queries, rows = (t.select("id", F.transform("v", lambda x: x.cast("double")).alias("v")).where(_valid(F.col("v"))) for t in (queries, rows))
    m, n = _blocks(queries, queries_a_block), _blocks(rows, rows_a_block)
    each = lambda name, count: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    own = lambda name, count: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int").alias(name)
    left, right = queries.select("*", own("a", m), each("b", n)), rows.select("*", own("b", n), each("a", m))
    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(_best(k), "query_id long, id long, cosine double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "id"))  # k rows a block
    return found.withColumn("place", place).where(F.col("place") <= k).select("query_id", "place", "id", "cosine")


def _farthest(chosen: np.ndarray, taken: set[int]):
    """Of each partition's rows that with the least cosine to what it is near already and to ``chosen``; ties: the smaller id."""

    def run(batches):
        best = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, near = batch.column("id").to_numpy(), batch.column("near").to_numpy(zero_copy_only=False).astype(float)
            u = np.array(batch.column("u").to_pylist(), float)
            if len(chosen):
                near = np.fmax(near, np.round(u @ chosen.T, 9).max(axis=1))
            near = np.where(np.isnan(near), -2.0, near)
            near[np.isin(ids, list(taken))] = np.inf
            i = np.lexsort((ids, near))[0]
            if np.isfinite(near[i]) and (best is None or (near[i], ids[i]) < best[:2]):
                best = near[i], ids[i], u[i]
        yield pa.RecordBatch.from_arrays([pa.array([] if best is None else [x], t) for x, t in zip(best or (0, 0, []), (pa.float64(), pa.int64(), pa.list_(pa.float64())))], ["near", "id", "u"])

    return run


def kcenter_greedy(pool: DataFrame, existing: DataFrame, k: int = 8) -> DataFrame:
    """step, vec_id, distance: ``k`` times the row of ``pool`` (id, v) farthest by cosine from ``existing`` (id, v) and from what is chosen; null where there is nothing yet.

    Cosines to the existing rows come from blocks, once, and are written; a round passes over the pool with the vectors chosen so far (at most ``k``) and sends a row a
    partition. Zero, null and non-finite vectors are not eligible; vectors of another length than the pool's longest are left out; ties go to the smallest id."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    width = pool.agg(F.max(F.size("v"))).first()[0] or 0
    first = nearest(pool.where(F.size("v") == width), existing, 1).select(F.col("query_id").alias("_q"), F.col("cosine").alias("near"))
    rows = pool.where(_valid(F.col("v")) & (F.size("v") == width)).withColumn("_n", norm).select("id", F.transform("v", lambda x: x.cast("double") / F.col("_n")).alias("u"))
    rows = held(rows.join(first, F.col("id") == F.col("_q"), "left").select("id", "u", "near"), "pool")
    out, chosen, some = [], [], existing.where(_valid(F.col("v"))).limit(1).count() > 0
    for step in range(k):
        found = rows.mapInArrow(_farthest(np.array(chosen), {r[1] for r in out}), "near double, id long, u array<double>")
        best = found.agg(F.min(F.struct("near", "id", "u")).alias("b")).first()["b"]
        if best is None:
            break
        out.append((step, best["id"], round(1 - best["near"], 6) if some or chosen else None))
        chosen.append(list(best["u"]))
    return pool.sparkSession.createDataFrame(out, "step int, vec_id long, distance double")


def _kcenter(s, d):
    rows = lambda where: _read(s, d, "embeddings").where(where).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return kcenter_greedy(rows("label <> 0"), rows("label = 0"))


def _read(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _search(s, d, k: int, among: DataFrame | None = None) -> DataFrame:
    """The stated query set, every row whose id is divisible by 100, against all rows or those ``among``."""
    rows = lambda: _read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return nearest(rows().where("id % 100 = 0"), rows() if among is None else rows().join(among, "id"), k)


def leakage(found: DataFrame, labels: DataFrame) -> DataFrame:
    """query_id, share of its neighbours under another label, and the most frequent of those (ties: the smallest)."""
    labels = labels.toDF("id", "label")
    both = found.join(labels, "id").join(labels.toDF("query_id", "query_label"), "query_id")
    foreign = both.where("label <> query_label").groupBy("query_id", "label").count().groupBy("query_id").agg(F.max_by("label", F.struct("count", -F.col("label"))).alias("top_foreign"))
    return both.groupBy("query_id").agg(F.round(F.avg((F.col("label") != F.col("query_label")).cast("double")), 6).alias("foreign_share")).join(foreign, "query_id", "left")


def agreement(found: DataFrame, labels: DataFrame) -> DataFrame:
    """query_id, share of its neighbours under its own label, and the share of the largest label of all."""
    labels = labels.toDF("id", "label")
    majority = labels.groupBy("label").count().agg((F.max("count") / F.sum("count")).alias("majority"))
    both = found.join(labels, "id").join(labels.toDF("query_id", "query_label"), "query_id")
    got = both.groupBy("query_id").agg(F.round(F.avg((F.col("label") == F.col("query_label")).cast("double")), 6).alias("agreement"))
    return got.join(F.broadcast(majority)).withColumn("majority", F.round("majority", 6))  # one row


def vote(found: DataFrame, answers: DataFrame) -> DataFrame:
    """query_id, proba: neighbours' answers (id, y) weighed by 1 / distance; neighbours at distance 0, where there are any, alone decide."""
    both = found.join(answers, "id").withColumn("d", F.round(1 - F.col("cosine"), 9))
    same = F.avg(F.when(F.col("d") <= 0, F.col("y")))
    return both.groupBy("query_id").agg(F.round(F.coalesce(same, F.sum(F.when(F.col("d") > 0, F.col("y") / F.col("d"))) / F.sum(F.when(F.col("d") > 0, 1 / F.col("d")))), 6).alias("proba"))


def _vote(s, d):
    known = _read(s, d, "labels").where("quality is not null").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"))
    return vote(_search(s, d, 15, known.select("id")), known)


QUERIES = {
    "neighbour_leakage": lambda s, d: leakage(_search(s, d, 25), _read(s, d, "embeddings").select("vec_id", "label")), "knn_label_agreement": lambda s, d: agreement(_search(s, d, 5), _read(s, d, "embeddings").select("vec_id", "label")),
    "knn_cosine_vote": _vote, "kcenter_greedy": _kcenter,
}


def _kcenter_sql(k: int = 8) -> str:
    """Round after round over every pair."""
    cos = "round(list_sum([z[1] * z[2] FOR z IN list_zip(p.u, e.u)]), 9)"
    steps = ["u AS (SELECT vec_id, label, [x::DOUBLE / n FOR x IN embedding] AS u FROM (SELECT *, sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding])) AS n FROM embeddings) WHERE n > 0)",
             f"s0 AS (SELECT p.vec_id, any_value(p.u) AS u, max({cos}) AS near FROM u p JOIN u e ON p.label <> 0 AND e.label = 0 GROUP BY p.vec_id)"]
    for i in range(k):
        steps += [f"c{i} AS (SELECT * FROM s{i} ORDER BY near, vec_id LIMIT 1)", f"s{i + 1} AS (SELECT p.vec_id, p.u, greatest(p.near, {cos}) AS near FROM s{i} p JOIN c{i} e ON p.vec_id <> e.vec_id)"]
    return f"WITH {', '.join(steps)} " + " UNION ALL ".join(f"SELECT {i} AS step, vec_id, round(1 - near, 6) AS distance FROM c{i}" for i in range(k))


def oracles() -> dict[str, str]:
    """Every pair of a query and a row, ranked."""
    dot = "list_sum([z[1]::DOUBLE * z[2]::DOUBLE FOR z IN list_zip(a.embedding, b.embedding)])"
    norm = "sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN {0}.embedding]))"
    pairs = lambda rows, k: f"""WITH p AS (SELECT a.vec_id AS query_id, a.label AS ql, b.vec_id AS id, b.label, round({dot} / ({norm.format('a')} * {norm.format('b')}), 9) AS c FROM embeddings a JOIN {rows} b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
k AS (SELECT * FROM p WHERE isfinite(c) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) <= {k})"""  # noqa: E731
    return {
        "kcenter_greedy": _kcenter_sql(), "neighbour_leakage": f"{pairs('embeddings', 25)}, f AS (SELECT query_id, label, count(*) AS n FROM k WHERE label <> ql GROUP BY ALL), t AS (SELECT query_id, arg_max(label, n * 1000000 - label) AS top_foreign FROM f GROUP BY query_id) SELECT query_id, round(avg((label <> ql)::INT), 6) AS foreign_share, any_value(top_foreign) AS top_foreign FROM k LEFT JOIN t USING (query_id) GROUP BY query_id",
        "knn_label_agreement": f"{pairs('embeddings', 5)}, m AS (SELECT max(n) / sum(n) AS majority FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)) SELECT query_id, round(avg((label = ql)::INT), 6) AS agreement, round(any_value(majority), 6) AS majority FROM k, m GROUP BY query_id",
        "knn_cosine_vote": f"{pairs('(SELECT e.*, quality FROM embeddings e JOIN labels ON doc_id = vec_id WHERE quality IS NOT NULL)', 15)}, y AS (SELECT k.*, quality, round(1 - c, 9) AS d FROM k JOIN labels ON doc_id = id) SELECT query_id, round(coalesce(avg(quality) FILTER (d <= 0), sum(quality / d) FILTER (d > 0) / sum(1 / d) FILTER (d > 0)), 6) AS proba FROM y GROUP BY query_id",
    }
