"""The split of the silos into two sides that the fewest shared papers cross.

Papers are told apart by their identity (DOI, else title, else id). An identity's silos are a short list, so links are counted from lists, not by a join of
papers. Every bipartition but mirror images is looked at: their numbers are a range that Spark deals to tasks, a task keeps its best one. Balanced are those whose
sides differ by ``most_apart`` silos and by the given shares of positives and rows; fewest crossing links win, then the least summed cosine of briefs across, then the smallest number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.catalogue import CATALOGUE as C
from ..plans.held import held
from .integrity import DOI
from .lexblock import norm_text, tokens

#: Bipartitions grow as a power of two of the silos.
MOST_SILOS = 26


def identity(doi, title, key) -> F.Column:
    """What a paper is known by across silos."""
    bare = norm_text(title)
    return F.when(F.trim(F.coalesce(doi, F.lit(""))) != "", F.concat(F.lit("doi:"), F.lower(F.trim(doi)))).when(bare != "", F.concat(F.lit("ttl:"), bare)).otherwise(F.concat(F.lit("id:"), key.cast("string")))


def shared_links(papers: DataFrame) -> DataFrame:
    """a, b, w: identities that silos a < b share (papers: silo, identity)."""
    lists = papers.where("silo is not null").groupBy("identity").agg(F.array_sort(F.collect_set("silo")).alias("s")).where(F.size("s") > 1)  # a list is as long as there are silos
    pairs = F.flatten(F.transform("s", lambda x: F.transform(F.filter("s", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return lists.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("w"))


def topic_cosines(briefs: DataFrame) -> DataFrame:
    """a, b, c: cosine of the token counts of two silos' briefs (silo, text); 0 where a brief has no token."""
    counts = held(briefs.select("silo", F.explode(tokens("text")).alias("t")).groupBy("silo", "t").agg(F.count("*").cast("double").alias("f")), "counts")
    norms = counts.groupBy("silo").agg(F.sqrt(F.sum(F.col("f") * F.col("f"))).alias("n"))
    dots = counts.toDF("a", "t", "x").join(counts.toDF("b", "t", "y"), "t").where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("d"))
    return dots.join(norms.toDF("a", "na"), "a").join(norms.toDF("b", "nb"), "b").select("a", "b", (F.col("d") / (F.col("na") * F.col("nb"))).alias("c"))


def least_leak(papers: DataFrame, briefs: DataFrame, most_apart: int = 1, positives: float = 0.12, rows: float = 0.15) -> DataFrame:
    """mask, cut, topic, pos_imbalance, row_imbalance: the best split of the silos by name, bit i set where the i-th is on the first side; no row where none is balanced.

    papers: silo, identity, y (1 for a positive, null unlabelled); briefs: silo, text. At most ``MOST_SILOS`` silos."""
    spark = papers.sparkSession
    sums = papers.where("silo is not null").groupBy("silo").agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("p")).orderBy("silo").limit(MOST_SILOS + 1).collect()
    if len(sums) > MOST_SILOS:
        raise ValueError(f"over {MOST_SILOS} silos")
    at, k = {r["silo"]: i for i, r in enumerate(sums)}, len(sums)
    share, topic = np.zeros((k, k)), np.zeros((k, k))
    for r in shared_links(papers).collect():  # a row a pair of silos
        share[at[r["a"]], at[r["b"]]] = share[at[r["b"]], at[r["a"]]] = r["w"]
    for r in topic_cosines(briefs).collect():
        if r["a"] in at and r["b"] in at:
            topic[at[r["a"]], at[r["b"]]] = topic[at[r["b"]], at[r["a"]]] = r["c"]
    n, p = np.array([r["n"] for r in sums], float), np.array([r["p"] for r in sums], float)

    def best(batches):
        kept = None
        for batch in batches:
            masks = batch.column("id").to_numpy()
            side = (masks[:, None] >> np.arange(k)) & 1
            sign = 2.0 * side - 1
            apart = np.abs(sign.sum(axis=1))
            pos, row = np.abs(sign @ p) / max(1.0, p.sum()), np.abs(sign @ n) / max(1.0, n.sum())
            ok = np.flatnonzero((apart <= most_apart) & (pos <= positives + 1e-12) & (row <= rows + 1e-12))
            if not len(ok):
                continue
            s = side[ok].astype(float)
            cut, topical = ((s @ share) * (1 - s)).sum(axis=1), np.round(((s @ topic) * (1 - s)).sum(axis=1), 9)
            i = np.lexsort((masks[ok], topical, cut))[0]
            found = float(cut[i]), float(topical[i]), int(masks[ok][i]), float(pos[ok][i]), float(row[ok][i])
            kept = found if kept is None else min(kept, found)
        out = [kept] if kept else []
        kinds = (pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate(kinds)], ["cut", "topic", "mask", "pos", "row"])

    found = spark.range(1, 1 << max(0, k - 1)).mapInArrow(best, "cut double, topic double, mask long, pos double, row double")
    one = found.agg(F.min(F.struct("cut", "topic", "mask", "pos", "row")).alias("b")).where("b is not null")
    return one.select("b.mask", F.col("b.cut").cast("long").alias("cut"), F.round("b.topic", 6).alias("topic"), F.round("b.pos", 6).alias("pos_imbalance"), F.round("b.row", 6).alias("row_imbalance"))


def _query(s, d) -> DataFrame:
    table = lambda t: s.read.parquet(f"{d}/{t}.parquet")
    rows = C.view_frame(s, "papers", table).withColumn("doi", F.expr(DOI)).join(table("labels").select(F.col("doc_id").alias("paper_id"), (1 - F.col("quality")).alias("y")), "paper_id", "left")
    rows = rows.select("silo", identity(F.col("doi"), F.col("title"), F.col("paper_id")).alias("identity"), "y")
    return least_leak(rows, C.view_frame(s, "briefs", table).select("silo", "text"))


QUERIES = {"min_leak_partition": _query}


def oracles() -> dict[str, str]:
    """Every balanced split with its sums by joins over the silos and their pairs."""
    tok = "regexp_extract_all(trim(regexp_replace(translate(lower(coalesce({0}, '')), '-/', '  '), '[ \\t\\n\\r]+', ' ', 'g')), '[a-z0-9]+')"
    bare = "trim(regexp_replace(translate(lower(coalesce(split_part(text, chr(10), 1), '')), '-/', '  '), '[ \\t\\n\\r]+', ' ', 'g'))"
    side = lambda x: f"((mask >> {x}::BIGINT) & 1)"
    return {
        "min_leak_partition": f"""WITH {C.sql_views('briefs')}, p AS (SELECT source AS silo, quality, CASE WHEN doc_id % 3 = 0 THEN 'doi:10.1/' || md5(text)[1:12] WHEN {bare} <> '' THEN 'ttl:' || {bare} ELSE 'id:' || doc_id END AS k FROM documents LEFT JOIN labels USING (doc_id)),
n AS (SELECT silo, row_number() OVER (ORDER BY silo) - 1 AS i, count(*) AS n, count(*) FILTER (quality = 0) AS p FROM p GROUP BY silo), e AS (SELECT a.i AS a, b.i AS b, count(*) AS w FROM (SELECT DISTINCT silo, k FROM p) x JOIN (SELECT DISTINCT silo, k FROM p) y USING (k) JOIN n a ON a.silo = x.silo JOIN n b ON b.silo = y.silo WHERE x.silo < y.silo GROUP BY ALL),
f AS (SELECT silo, t, count(*)::DOUBLE AS f FROM (SELECT silo, unnest({tok.format('text')}) AS t FROM briefs) GROUP BY ALL), c AS (SELECT a.i AS a, b.i AS b, sum(x.f * y.f) / (sqrt((SELECT sum(f * f) FROM f WHERE silo = a.silo)) * sqrt((SELECT sum(f * f) FROM f WHERE silo = b.silo))) AS c FROM f x JOIN f y USING (t) JOIN n a ON a.silo = x.silo JOIN n b ON b.silo = y.silo WHERE x.silo < y.silo GROUP BY a.i, b.i, a.silo, b.silo),
m AS (SELECT unnest(range(1, (1 << (count(*) - 1)::INT)::BIGINT)) AS mask, count(*) AS k, sum(n) AS n_all, sum(p) AS p_all FROM n),
h AS (SELECT mask, abs(2 * bit_count(mask) - any_value(k)) AS apart, abs(sum((2 * {side('i')} - 1) * p)) / any_value(p_all) AS pos, abs(sum((2 * {side('i')} - 1) * n)) / any_value(n_all) AS r FROM (SELECT * FROM m WHERE abs(2 * bit_count(mask) - k) <= 1) CROSS JOIN n GROUP BY mask),
g AS (SELECT * FROM h WHERE pos <= 0.12 AND r <= 0.15), w AS (SELECT mask, sum(w) FILTER ({side('a')} <> {side('b')}) AS cut FROM g CROSS JOIN e GROUP BY mask), t AS (SELECT mask, round(sum(c) FILTER ({side('a')} <> {side('b')}), 9) AS topic FROM g CROSS JOIN c GROUP BY mask)
SELECT mask, coalesce(cut, 0)::BIGINT AS cut, round(coalesce(topic, 0), 6) AS topic, round(pos, 6) AS pos_imbalance, round(r, 6) AS row_imbalance FROM g LEFT JOIN w USING (mask) LEFT JOIN t USING (mask) ORDER BY coalesce(cut, 0), coalesce(topic, 0), mask LIMIT 1""",
    }
