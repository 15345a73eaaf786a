"""Registered queries of the corpus operators, at production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import annulus, covertree, gumbel, linedup, mixing, nbsvm, packing, recompression, simhash, tries, warc, webp, wrappers


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html(spark, sf_dir):
    return wrappers.extract_pages(_table(spark, sf_dir, "pages"))


def op2_sentencepiece(spark, sf_dir):
    return gumbel.sample_segmentations(_table(spark, sf_dir, "documents"))


def op3_warc(spark, sf_dir):
    return warc.archive_digest(_table(spark, sf_dir, "pages"))


def op5_webp(spark, sf_dir):
    return webp.media_digest(_table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark, sf_dir):
    return covertree.near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_simhash(spark, sf_dir):
    return simhash.dedup_digest(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark, sf_dir):
    return linedup.dedup_digest(_table(spark, sf_dir, "documents"))


def op7_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark, sf_dir):
    return recompression.dedup_digest(_table(spark, sf_dir, "documents"))


def op10_quality(spark, sf_dir):
    return nbsvm.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_mixing(spark, sf_dir):
    return mixing.shares(_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark, sf_dir):
    return tries.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_centroids(spark, sf_dir):
    return annulus.clusters(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    known = (
        op1_html, op2_sentencepiece, op3_warc, op4_simhash, op5_webp, op6_line_dedup, op7_packing, op8_embedding_dedup, op9_substring_dedup, op10_quality, op11_mixing,
        op12_prefix_trie, op13_centroids,
    )
    return {f.__name__: f for f in known}


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM p),
m AS (SELECT s, min(doc_id) AS lo FROM v GROUP BY s HAVING min(doc_id) < max(doc_id)),
g AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS gone FROM v JOIN m USING (s) WHERE doc_id > lo GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE [w[k] FOR k IN range(1, len(w) + 1) IF NOT list_contains(gone, k)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""


#: Copies counted by digest; eight groups of five hex digits give four letters each.
OP3_SQL = r"""
WITH p AS (SELECT page_id, translate(coalesce(url, ''), chr(13) || chr(10), '') AS url, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, max(page_id) AS first FROM p GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(flatten([[substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, 5 * g + 1, 5))::BIGINT >> b) & 31) + 1)::INT, 1) FOR b IN [15, 10, 5, 0]] FOR g IN range(8)]), '') AS payload_digest,
  CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < first THEN first END AS refers_to, url FROM p JOIN f USING (h)
"""

#: Every pair of vectors, and all that links reach.
OP8_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, [x / n FOR x IN e] AS u FROM (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding])) AS n FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0) WHERE n > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.u) = len(b.u) WHERE list_sum([z[1] * z[2] FOR z IN list_zip(a.u, b.u)]) >= 0.9),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, least(vec_id, (SELECT min(b) FROM r WHERE r.a = e.vec_id)) AS component_id, vec_id <= coalesce((SELECT min(b) FROM r WHERE r.a = e.vec_id), vec_id) AS kept FROM embeddings e
"""

#: The level is read off the sources in order of cap over weight: one is clamped where filling all up to its level takes less than the total.
OP11_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  md5(concat_ws(':', 'mix', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))) AS k FROM documents),
s AS (SELECT source, sum(size) AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT source, n, w, sum(3 * n) OVER upto AS caps, sum(w) OVER () - sum(w) OVER upto AS above, sum(n) OVER () AS total FROM s WINDOW upto AS (ORDER BY n::DOUBLE / w)),
c AS (SELECT *, caps * w + 3 * n * above < total * w AS clamped FROM o),
l AS (SELECT any_value(total) - coalesce(sum(3 * n) FILTER (clamped), 0) AS rest, sum(w) - coalesce(sum(w) FILTER (clamped), 0) AS weight FROM c),
t AS (SELECT source, n, CASE WHEN clamped THEN 3 * n::DOUBLE ELSE w::DOUBLE * rest::DOUBLE / weight::DOUBLE END AS target FROM c, l),
q AS (SELECT *, floor(target + 0.5)::BIGINT AS words FROM t),
r AS (SELECT doc_id, size, n::BIGINT AS n, target, words // greatest(n, 1)::BIGINT AS whole, words % greatest(n, 1)::BIGINT AS quota,
  sum(size) OVER (PARTITION BY d.source ORDER BY k ROWS UNBOUNDED PRECEDING) - size AS before FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, n AS source_size, target, (whole * size + greatest(0, least(size, quota - before)))::BIGINT AS taken FROM r
"""

OP12_SQL = r"""
WITH tab AS (SELECT [list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) FOR i IN range(256)] AS tab),
o AS (SELECT conv_id, dig, chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, dig) AS i FROM (
  SELECT conv_id, turn, length(coalesce(text, '')) AS chars, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS dig FROM conversations WHERE conv_id IS NOT NULL)),
n AS (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id),
b AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce([4294967295] || [ord(x) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')],
  lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h FROM n, tab),
r AS (SELECT b.conv_id, o.i AS d, dig, chars FROM b JOIN o ON o.conv_id = b.base AND o.i <= h
  UNION ALL SELECT conv_id, i - h + least(h, coalesce(n.n, 0)), dig, chars FROM b JOIN o USING (conv_id) LEFT JOIN n ON n.conv_id = b.base WHERE i > h),
p AS (SELECT conv_id, d, chars, sha256(string_agg(dig, '') OVER (PARTITION BY conv_id ORDER BY d)) AS k FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM n),
m AS (SELECT conv_id, max(d) AS last FROM p GROUP BY conv_id),
v AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = last) AS ends FROM p JOIN m USING (conv_id) GROUP BY d, k),
e AS (SELECT v.k, v.d, u.k AS up, u.d AS dup, a.conv_id AS up_conv FROM v JOIN p u ON u.conv_id = v.conv_id AND u.d = v.d - 1 JOIN v a ON a.k = u.k AND a.d = u.d),
c AS (SELECT up, dup, count(*) AS n FROM e GROUP BY up, dup),
w AS (SELECT v.*, coalesce(c.n, 0) AS kids FROM v LEFT JOIN c ON c.up = v.k AND c.dup = v.d),
s AS (SELECT u.k, u.d, count(*) FILTER (w.kids = 0) AS leaves, sum((w.n - 1) * w.chars) AS saved FROM w JOIN p u ON u.conv_id = w.conv_id AND u.d <= w.d GROUP BY u.k, u.d)
SELECT w.conv_id, w.d::BIGINT AS depth, e.up_conv AS parent_conv_id, w.n::BIGINT AS n_convs, w.kids::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves,
  s.saved::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256 FROM w JOIN s ON s.k = w.k AND s.d = w.d LEFT JOIN e ON e.k = w.k AND e.d = w.d
"""


def _op13_sql(k: int = annulus.K, rounds: int = annulus.ROUNDS) -> str:
    """The rounds written out, every vector compared with every centroid."""
    near = "SELECT r, vec_id, min(row(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(x.v, c.v)])::BIGINT, k)) AS near, any_value(x.v) AS v FROM x, c{0} c GROUP BY r, vec_id"
    mean = (
        "SELECT k, list(m ORDER BY i) AS v FROM (SELECT k, i, ((s - (s % n + n) % n) // n)::BIGINT AS m FROM (SELECT near[2] AS k, i, sum(y) AS s, count(*) AS n FROM "
        "(SELECT near, unnest(v) AS y, unnest(range(1, 65)) AS i FROM a{0}) GROUP BY near[2], i)) GROUP BY k"
    )
    steps = [
        "x AS (SELECT row_number() OVER () AS r, vec_id, [floor(64 * CAST(y AS DOUBLE))::BIGINT FOR y IN embedding] AS v FROM embeddings "
        "WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)",
        f"c0 AS (SELECT k, v FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS k, v FROM x) WHERE k < {k})",
    ]
    for i in range(rounds):
        steps += [f"a{i} AS ({near.format(i)})", f"m{i} AS ({mean.format(i)})", f"c{i + 1} AS (SELECT k, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (k))"]
    return (
        f"WITH {', '.join(steps)}, z AS ({near.format(rounds)}) SELECT vec_id, near[2]::INT AS cluster, near[1] AS distance, (sum(near[1]) OVER (PARTITION BY near[2]))::BIGINT AS cluster_inertia, "
        f"(sum(near[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256 FROM z JOIN c{rounds} ON k = near[2]"
    )


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3_SQL, "op8_embedding_dedup": OP8_SQL, "op9_substring_dedup": OP9_SQL, "op11_mixing": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_centroids": _op13_sql()}
