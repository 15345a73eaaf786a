"""Metrics of rankings by cosine: the stated query set (ids divisible by 100) against all labelled vectors, block by block.

A task multiplies a block of vectors by a block of queries and gives out each query's cosines as whole numbers of billionths (what the SQL rounds to) in one row; a query's
(and label's) rows meet in one group of numpy arrays, some bytes a vector. Pairs without a cosine are left out: vectors that are null, zero, hold nulls or differ in length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.held import held

#: Vectors of a block, queries of a block, vectors of a partition.
ROWS, QUERIES_EACH, PART = 4096, 512, 20_000
UNIT, NOT_A_NUMBER = 1_000_000_000, (1 << 31) - 1
#: Cosines that a task ranks together, rows that are put in order of their cosine, rows of a batch that leaves a task.
PAIRS, ARMS, BATCH = 1 << 23, 1 << 22, 1 << 16
PACKED = "d int, ids array<long>, labels array<int>, ys array<int>, x binary"


def _pack(batches):
    """Unit vectors of one length in a row; y is -1 where it is null."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS).to_pydict()
            widths: dict[int, list[int]] = {}
            for i, e in enumerate(part["embedding"]):
                if e and None not in e:
                    widths.setdefault(len(e), []).append(i)
            for d, rows in widths.items():
                x = np.array([part["embedding"][i] for i in rows], float).reshape(len(rows), d)
                norm = np.sqrt((x * x).sum(axis=1))
                some = np.flatnonzero(norm != 0)
                with np.errstate(invalid="ignore"):
                    x = x[some] / norm[some, None]
                pick = lambda c: [part[c][rows[i]] for i in some]
                columns = [pa.array([d], pa.int32()), pa.array([pick("id")], pa.list_(pa.int64())), pa.array([pick("label")], pa.list_(pa.int32())), pa.array([[-1 if y is None else y for y in pick("y")]], pa.list_(pa.int32())), pa.array([x.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["d", "ids", "labels", "ys", "x"])


def _cosines(by_label: bool):
    """query_id, label (null unless asked for), c, ids, ys: a query's cosines to a block, as bytes."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c: batch.column(c)[i].as_py()  # noqa: E731, B023
                d, ids, ys, queries = get("d"), np.array(get("ids"), np.int64), np.array(get("ys"), np.int8), get("q_ids")
                if not len(ids) or not queries:
                    continue
                c = np.frombuffer(get("q_x"), float).reshape(-1, d) @ np.frombuffer(get("x"), float).reshape(-1, d).T
                c = np.where(np.isnan(c), NOT_A_NUMBER, np.rint(np.nan_to_num(c) * UNIT)).astype(np.int32)
                labels = get("labels")
                parts = {label: np.array([j for j, x in enumerate(labels) if x == label]) for label in set(labels)} if by_label else {None: np.arange(len(ids))}
                for label, at in parts.items():
                    n = len(queries)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(queries, pa.int64()), pa.array([label] * n, pa.int32()), pa.array([r.tobytes() for r in c[:, at]], pa.binary()), pa.array([b"" if by_label else ids[at].tobytes()] * n, pa.binary()), pa.array([ys[at].tobytes()] * n, pa.binary())],
                        ["query_id", "label", "c", "ids", "ys"],
                    )

    return run


def cosines(vectors: DataFrame, labels: DataFrame, by_label: bool) -> DataFrame:
    """vectors: vec_id, label, embedding; labels: vec_id, y, or None: all vectors, with y 0."""
    known = vectors.withColumn("y", F.lit(0)) if labels is None else vectors.join(labels, "vec_id")
    rows = known.select(F.col("vec_id").alias("id"), "label", F.col("y").cast("int").alias("y"), "embedding")
    asked = vectors.where(f"vec_id % 100 = 0 and vec_id <> {NO_ID}").select(F.col("vec_id").alias("id"), "label", F.lit(0).alias("y"), "embedding")
    blocks = rows.repartition(1 + vectors.count() // PART).mapInArrow(_pack, PACKED)
    asked = asked.repartition(1 + asked.count() // QUERIES_EACH).mapInArrow(_pack, PACKED).select("d", F.col("ids").alias("q_ids"), F.col("x").alias("q_x"))
    return blocks.join(F.broadcast(asked), "d").mapInArrow(_cosines(by_label), "query_id long, label int, c binary, ids binary, ys binary")  # a hundredth of the vectors in every task


def _gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    joined = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    return joined("c", np.int32), joined("ids", np.int64), joined("ys", np.int8)


def _auc(c: np.ndarray, y: np.ndarray) -> float | None:
    """By average ranks; what is not 1 counts as other, as in the SQL."""
    _, at, n = np.unique(c, return_inverse=True, return_counts=True)
    rank = (n.cumsum() - (n - 1) / 2)[at]
    pos = int((y == 1).sum())
    return float((rank[y == 1].sum() - pos * (pos + 1) / 2) / (float(pos) * (len(y) - pos))) if pos and pos < len(y) and (y >= 0).any() else None


def _auc_row(table: pa.Table) -> pa.Table:
    c, _, y = _gathered(table)
    return pa.table({"query_id": table.column("query_id")[:1], "label": table.column("label")[:1], "auc": pa.array([_auc(c, y)], pa.float64())})


def _metrics_row(table: pa.Table) -> pa.Table:
    c, ids, y = _gathered(table)
    order = np.lexsort((ids, -c.astype(np.int64)))
    hits = (y[order] == 1).cumsum()
    pos, n = int(hits[-1]), len(y)
    recall = wss = achieved = None
    if pos:
        k = int(np.searchsorted(hits, 0.95 * pos)) + 1
        recall, wss, achieved = float(hits[min(10, n) - 1] / pos), 0.95 - k / n, float(hits[k - 1] / pos)
    row = {"auc": _auc(c, y), "recall_10": recall, "wss": wss, "recall_achieved": achieved}
    return pa.table({"query_id": table.column("query_id")[:1], **{name: pa.array([v], pa.float64()) for name, v in row.items()}})


def transfer_auc(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """query_id, label, AUC of the cosine to the query over each label's rows; labels: vec_id, y."""
    return cosines(vectors, labels, True).groupBy("query_id", "label").applyInArrow(_auc_row, "query_id long, label int, auc double").withColumn("auc", F.round("auc", 6))


def retrieval(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """query_id, AUC, recall in the first ten, work saved at 95 % recall and the recall there; ties in cosine by id."""
    got = cosines(vectors, labels, False).groupBy("query_id").applyInArrow(_metrics_row, "query_id long, auc double, recall_10 double, wss double, recall_achieved double")
    return got.select("query_id", *[F.round(c, 6).alias(c) for c in ("auc", "recall_10", "wss", "recall_achieved")])


#: Stands for a null id in arrays.
NO_ID = -(1 << 63)
PAIRS_ROW = "vec_id long, query_id long, cosine double, pr double"


def _half_up(x: np.ndarray) -> np.ndarray:
    """Rounded to six places, halves away from zero, as SQL rounds."""
    return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5) / 1e6, x) + 0.0


def _with_width(vectors: DataFrame) -> DataFrame:
    """id, embedding, d: the length of a vector that has a direction, else null."""
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda v: v.isNull())
    square = F.aggregate("embedding", F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    return vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("id"), "embedding", F.when(whole & (square != 0), F.size("embedding")).alias("d"))


def _ranked_rows(table: pa.Table) -> pa.Table:
    """A query's rows with the average-tie percent rank of their cosines, by whole numbers."""
    c, ids, _ = _gathered(table)
    _, at, n = np.unique(c, return_inverse=True, return_counts=True)
    twice = (2 * n.cumsum() - (n - 1))[at]  # the rank, doubled
    rank = (4_000_000 * twice + 4 * len(c)) // (8 * len(c)) / 1e6
    cosine = np.where(c == NOT_A_NUMBER, np.nan, np.sign(c) * ((np.abs(c.astype(np.int64)) + 500) // 1000) / 1e6 + 0.0)
    return pa.table({"vec_id": pa.array(ids, pa.int64(), mask=ids == NO_ID), "query_id": pa.repeat(table.column("query_id")[0], len(c)), "cosine": cosine, "pr": rank})


def _asked_blocks(most: int):
    """Queries of one width, ``most`` of them in a row."""

    def run(batches):
        held_back: dict[int, list[tuple]] = {}
        for batch in _pack(batches):
            for row in batch.to_pylist():
                x = np.frombuffer(row["x"], float).reshape(-1, row["d"])
                waiting = held_back.setdefault(row["d"], [])
                waiting += zip(row["ids"], x, strict=True)
                while len(waiting) >= most:
                    yield _asked_row(row["d"], waiting[:most])
                    del waiting[:most]
        yield from (_asked_row(d, waiting) for d, waiting in held_back.items() if waiting)

    return run


def _asked_row(d: int, queries: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([[q for q, _ in queries]], pa.list_(pa.int64())), pa.array([b"".join(x.tobytes() for _, x in queries)], pa.binary())], ["q_d", "q_ids", "q_x"])


def _ranked_blocks(batches):
    """Rows as ``_ranked_rows`` gives them for a block of queries after all blocks of vectors have passed.

    The rows of all queries come out by their place in the ranking: equal ranks lie together and like cosines near each other, which Parquet stores in a few bits."""
    blocks: dict[tuple, list[tuple]] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            get = lambda c: batch.column(c)[i].as_py()  # noqa: E731, B023
            d, ids, queries = get("d"), np.array(get("ids"), np.int64), tuple(get("q_ids"))
            if len(ids):
                c = np.frombuffer(get("q_x"), float).reshape(-1, d) @ np.frombuffer(get("x"), float).reshape(-1, d).T
                blocks.setdefault(queries, []).append((ids, np.where(np.isnan(c), NOT_A_NUMBER, np.rint(np.nan_to_num(c) * UNIT)).astype(np.int32)))
    for queries in list(blocks):
        parts = blocks.pop(queries)
        ids = np.concatenate([x for x, _ in parts])
        n, shape = len(ids), (len(queries), len(ids))
        c, order, twice = np.empty(shape, np.int32), np.empty(shape, np.int32), np.empty(shape, np.int32)
        for k in range(len(queries)):
            own = np.concatenate([x[k] for _, x in parts])
            order[k] = np.argsort(own)
            c[k] = own[order[k]]
            first = np.flatnonzero(np.append(True, c[k, 1:] != c[k, :-1]))
            last = np.append(first[1:], n) - 1
            twice[k] = np.repeat(first + last + 2, last - first + 1)  # the rank, doubled
        del parts
        q, each = np.array(queries, np.int64), max(1, BATCH // len(queries))
        for at in range(0, n, each):
            place = slice(at, at + each)
            vec, cos, pr = (np.ascontiguousarray(x[:, place].T).ravel().astype(np.int64) for x in (order, c, twice))
            vec, pr = ids[vec], (4_000_000 * pr + 4 * n) // (8 * n) / 1e6
            cosine = np.where(cos == NOT_A_NUMBER, np.nan, np.sign(cos) * ((np.abs(cos) + 500) // 1000) / 1e6 + 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(vec, mask=vec == NO_ID), pa.array(np.tile(q, len(vec) // len(q))), pa.array(cosine), pa.array(pr)], ["vec_id", "query_id", "cosine", "pr"])


def _rankings(vectors: DataFrame) -> DataFrame:
    """``cosine_ranks`` of the pairs that have a cosine. A task ranks a block of queries while all blocks of vectors stream past it: no pair is shuffled.

    vectors: vec_id, label, embedding; ids of queries are keys. A task holds ``PAIRS`` cosines, or one query's."""
    n = vectors.count()
    rows = vectors.select(F.col("vec_id").alias("id"), "label", F.lit(0).alias("y"), "embedding")
    asked = held(rows.where(f"id % 100 = 0 and id <> {NO_ID}"), "asked")
    queries = asked.count()
    most = max(1, min(PAIRS // max(1, n), -(-queries // vectors.sparkSession.sparkContext.defaultParallelism)))
    blocks = held(rows.repartition(1 + n // PART).mapInArrow(_pack, PACKED).select("d", "ids", "x"), "vectors")
    asked = asked.coalesce(1).mapInArrow(_asked_blocks(most), "q_d int, q_ids array<long>, q_x binary").repartition(1 + queries // most)  # a hundredth of the vectors, dealt evenly
    return blocks.coalesce(1).join(asked.hint("shuffle_replicate_nl"), F.col("d") == F.col("q_d")).mapInArrow(_ranked_blocks, PAIRS_ROW)


def cosine_ranks(vectors: DataFrame) -> DataFrame:
    """vec_id, query_id, cosine and its percent rank within the query: a row for each vector and query, null where there is no cosine."""
    rows = _with_width(vectors)
    known = rows.select(F.col("id").alias("vec_id"), F.lit(0).alias("label"), "embedding")
    asked = rows.where(f"id % 100 = 0 and id <> {NO_ID}").select(F.col("id").alias("query_id"), F.col("d").alias("q_d"))
    if asked.groupBy("query_id").count().where("count > 1").take(1):  # queries that share an id are ranked together
        got = cosines(known, None, False).groupBy("query_id").applyInArrow(_ranked_rows, PAIRS_ROW)
    else:
        got = _rankings(known)
    widths = asked.select(F.col("q_d").alias("w")).distinct()
    blank = rows.select("id", "d").join(F.broadcast(widths), ~F.coalesce(F.col("d") == F.col("w"), F.lit(False))).join(F.broadcast(asked), F.col("w").eqNullSafe(F.col("q_d")))
    none = F.lit(None).cast("double")
    return got.union(blank.select(F.nullif("id", F.lit(NO_ID)), "query_id", none, none))


def _arms(batches):
    """vec_id, query_id, the cosine to the query and to the next one, and their difference, for a block of vectors and all queries.

    ``ARMS`` rows at a time, in order of the cosine: Parquet stores the equal ones that then lie together once."""
    for batch in batches:
        for i in range(batch.num_rows):
            get = lambda c: batch.column(c)[i].as_py()  # noqa: E731, B023
            d, ids, queries = get("d"), np.array(get("ids"), np.int64), np.array(get("q_ids"), np.int64)
            x = np.frombuffer(get("x"), float).reshape(len(ids), -1)
            q, fits = np.frombuffer(get("q_x"), float).reshape(len(queries), -1), np.array(get("q_fits"), bool)
            most = max(1, ARMS // max(1, len(ids)))
            for first in range(0, len(queries), most):
                own = np.arange(first, min(first + most, len(queries)) + 1) % len(queries)  # and the last one's arm
                c = q[own] @ x.T if d else np.zeros((len(own), len(ids)))
                order = np.argsort(c[:-1], axis=None)
                for at in range(0, len(order), BATCH):
                    k, v = np.divmod(order[at:at + BATCH], len(ids))
                    one, two = c[k, v], c[k + 1, v]
                    no_c, no_o = ~fits[own[k]], ~fits[own[k + 1]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[v]), pa.array(queries[own[k]]), pa.array(_half_up(one), mask=no_c), pa.array(_half_up(two), mask=no_o), pa.array(_half_up(two - one), mask=no_c | no_o)],
                        ["vec_id", "query_id", "cos_brief", "cos_arm", "delta"],
                    )


def _beside(batches):
    """Vectors of one width in a row, unit length; those without a direction have width 0."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS).to_pydict()
            widths: dict[int, list[int]] = {}
            for i, d in enumerate(part["d"]):
                widths.setdefault(d or 0, []).append(i)
            for d, rows in widths.items():
                x = np.array([part["embedding"][i] for i in rows] if d else [], float).reshape(len(rows), d)
                x = x / np.sqrt((x * x).sum(axis=1))[:, None] if d else x
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([[part["id"][i] for i in rows]], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())], ["d", "ids", "x"])


def _asked(table: pa.Table) -> pa.Table:
    """All queries in order of their ids for vectors of one width; zeros for those of another."""
    table = table.sort_by("id")
    w = table.column("w")[0].as_py()
    fits = [d == w and w > 0 for d in table.column("d").to_pylist()]
    q = np.array([e if ok else [0.0] * w for e, ok in zip(table.column("embedding").to_pylist(), fits)], float).reshape(len(fits), w)
    norm = np.sqrt((q * q).sum(axis=1))
    q = q / np.where(norm != 0, norm, 1.0)[:, None]
    return pa.table({"w": pa.array([w], pa.int32()), "q_ids": pa.array([table.column("id").to_pylist()], pa.list_(pa.int64())), "q_x": pa.array([q.tobytes()], pa.binary()), "q_fits": pa.array([fits], pa.list_(pa.bool_()))})


def cosine_arms(vectors: DataFrame) -> DataFrame:
    """vec_id, query_id, cos_brief, cos_arm, delta of each vector and query, the arm being the next query by id (the last one's: the first); ids are keys."""
    rows = _with_width(vectors.where("vec_id is not null"))
    widths = rows.select(F.coalesce("d", F.lit(0)).alias("w")).distinct()
    asked = rows.where("id % 100 = 0").crossJoin(F.broadcast(widths)).groupBy("w").applyInArrow(_asked, "w int, q_ids array<long>, q_x binary, q_fits array<boolean>")  # a hundredth of the vectors
    blocks = rows.repartition(1 + vectors.count() // PART).mapInArrow(_beside, "d int, ids array<long>, x binary")
    return blocks.join(F.broadcast(asked), F.col("d") == F.col("w")).mapInArrow(_arms, "vec_id long, query_id long, cos_brief double, cos_arm double, delta double")


def _cosine_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    if vectors.groupBy("vec_id").count().where("count > 1").take(1):  # rows that share an id meet each other in the plan's join
        from ..plans.catalogue import CATALOGUE

        return CATALOGUE.query("add_cos_brief")(spark, sf_dir)
    return cosine_arms(vectors)


def _tables(spark: SparkSession, sf_dir: str, y) -> tuple[DataFrame, DataFrame]:
    vectors, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("embeddings", "labels"))
    return vectors, labels.select(F.col("doc_id").alias("vec_id"), y.alias("y"))


QUERIES = {"brief_transfer_auc": lambda s, d: transfer_auc(*_tables(s, d, F.col("quality"))), "retrieval_metrics": lambda s, d: retrieval(*_tables(s, d, 1 - F.col("quality"))),
           "cosine_to_brief": lambda s, d: cosine_ranks(s.read.parquet(f"{d}/embeddings.parquet")), "add_cos_brief": _cosine_arms}
