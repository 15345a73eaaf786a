"""Ranks, cosine similarity, centroids and embedding diagnostics."""

from __future__ import annotations

from ..plans.catalogue import CATALOGUE as C

R = lambda x, n=6: f"round(CAST({x} AS DOUBLE), {n})"
PCT = lambda v, p: f"(rank() OVER (PARTITION BY {p} ORDER BY {v}) + (count(*) OVER (PARTITION BY {p}, {v}) - 1) / 2e0) / count({v}) OVER (PARTITION BY {p})"
QUERY_COS = lambda d: f"SELECT v.vec_id, v.label, q.vec_id AS query_id, q.label AS query_label, CASE WHEN v.nrm > 0 AND q.nrm > 0 THEN {d.dot('v.embedding', 'q.embedding')} / (v.nrm * q.nrm) END AS c FROM vectors v CROSS JOIN (SELECT * FROM vectors WHERE vec_id % 100 = 0) q"  # the stated query set against all rows
# the second block over again, as wide as the first
WIDE = lambda d: f"SELECT vec_id, embedding AS a, {d.tiled('b', d.size('embedding'))} AS b FROM vectors JOIN letters USING (vec_id)"
CLASS_SUM = "SELECT label, i, sum(u) AS s, count(*) AS n FROM dims GROUP BY label, i"

C.add(
    pct_rank=lambda d: f"SELECT paper_id, CASE WHEN s IS NOT NULL THEN {R(PCT('s', 'silo'))} END AS pr FROM scored",
    # share of the other folds' values that are no larger: all values' cumulative counts less the own fold's, over distinct values
    pct_rank_train_ref=lambda d: f"WITH g AS (SELECT silo, s, paper_id % 5 AS fold, count(*) AS c FROM scored GROUP BY silo, s, paper_id % 5), a AS (SELECT silo, s, sum(sum(c)) OVER (PARTITION BY silo ORDER BY s) AS le, sum(sum(c)) OVER (PARTITION BY silo) AS n FROM g GROUP BY silo, s), f AS (SELECT silo, s, fold, sum(c) OVER (PARTITION BY silo, fold ORDER BY s) AS le, sum(c) OVER (PARTITION BY silo, fold) AS n FROM g) SELECT p.paper_id, {R('(a.le - f.le) * 1e0 / nullif(a.n - f.n, 0)')} AS share FROM scored p JOIN a ON p.silo = a.silo AND p.s = a.s JOIN f ON p.silo = f.silo AND p.s = f.s AND p.paper_id % 5 = f.fold",
    pairwise_cosine_mean=lambda d: f"WITH s AS (SELECT label, i, sum(u) AS s FROM dims GROUP BY label, i), n AS (SELECT label, count(*) AS n FROM vectors WHERE nrm > 0 GROUP BY label) SELECT s.label, {R('(sum(s * s) - max(n)) / (max(n) * (max(n) - 1e0))')} AS mean_cosine FROM s JOIN n ON s.label = n.label GROUP BY s.label HAVING max(n) > 1",
    pairwise_cosine_hist=lambda d: f"SELECT CAST(floor(c * 10 + 1e-9) AS BIGINT) AS bin, count(*) AS n FROM (SELECT {d.dot('a.embedding', 'b.embedding')} / nullif(a.nrm * b.nrm, 0) AS c FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id < b.vec_id) q GROUP BY 1",
    interpret_dispersion=lambda d: "WITH s AS (SELECT label, i, sum(u) AS s FROM dims GROUP BY label, i), n AS (SELECT label, count(*) AS n FROM vectors GROUP BY label), m AS (SELECT s.label, (sum(s * s) - max(n)) / nullif(max(n) * (max(n) - 1e0), 0) AS c FROM s JOIN n ON s.label = n.label GROUP BY s.label) SELECT label, CASE WHEN c > 0.7 THEN 'tight' WHEN c > 0.35 THEN 'moderate' WHEN c > 0.05 THEN 'loose' ELSE 'spread' END AS verdict FROM m",
    pct_rank_ordinal=lambda d: f"SELECT paper_id, {R('(row_number() OVER (PARTITION BY silo ORDER BY s, paper_id) - 1e0) / nullif(count(*) OVER (PARTITION BY silo) - 1, 0)')} AS pr FROM scored",
    cosine_to_brief=lambda d: f"WITH q AS ({QUERY_COS(d)}), z AS (SELECT vec_id, query_id, round(c, 9) AS c FROM q) SELECT vec_id, query_id, {R('c')} AS cosine, CASE WHEN c IS NOT NULL THEN {R(PCT('c', 'query_id, c IS NULL'))} END AS pr FROM z",
    # the same cosine under four treatments of zero vectors
    cosine_zero_policy=lambda d: f"WITH w AS ({WIDE(d)}), x AS (SELECT vec_id, {d.dot('a', 'b')} AS p, sqrt({d.dot('a', 'a')}) AS na, sqrt({d.dot('b', 'b')}) AS nb FROM w) SELECT vec_id, {R('p / nullif(na * nb, 0)')} AS as_null, {R('p / ((CASE WHEN na = 0 THEN 1e0 ELSE na END) * (CASE WHEN nb = 0 THEN 1e0 ELSE nb END))')} AS as_one, {R('p / (na * nb + 1e-9)')} AS plus_1e9, {R('p / greatest(na * nb, 1e-12)')} AS least_1e12 FROM x",
    cosine_1e12=lambda d: f"WITH w AS ({WIDE(d)}) SELECT vec_id, {R(d.dot('a', 'b') + ' / (sqrt(' + d.dot('a', 'a') + ') * sqrt(' + d.dot('b', 'b') + ') + 1e-12)')} AS cosine FROM w",
    # another arm of queries: each query's vector against the next query's, on the same rows
    add_cos_brief=lambda d: f"WITH q AS ({QUERY_COS(d)}), n AS (SELECT query_id, coalesce(lead(query_id) OVER (ORDER BY query_id), first_value(query_id) OVER (ORDER BY query_id)) AS arm_id FROM (SELECT DISTINCT query_id FROM q) z) SELECT q.vec_id, q.query_id, {R('q.c')} AS cos_brief, {R('o.c')} AS cos_arm, {R('o.c - q.c')} AS delta FROM q JOIN n ON n.query_id = q.query_id JOIN q o ON o.query_id = n.arm_id AND o.vec_id = q.vec_id",
    normalize_rows=lambda d: f"SELECT vec_id, {d.size('embedding')} AS dim, {R('CASE WHEN nrm = 0 THEN 0 ELSE sqrt(' + d.dot('embedding', 'embedding') + ') / nrm END')} AS norm_after, {R('CAST(' + d.at('embedding', 1) + ' AS DOUBLE) / CASE WHEN nrm = 0 THEN 1 ELSE nrm END')} AS first_u FROM vectors",
    mean_normalized_combo=lambda d: f"WITH x AS (SELECT vec_id, a, b, sqrt({d.dot('a', 'a')}) AS na, sqrt({d.dot('b', 'b')}) AS nb FROM ({WIDE(d)}) z), p AS (SELECT vec_id, a, b, na, nb, {d.each(d.seq(1, d.size('a')))} AS i FROM x) SELECT vec_id, i, {R('(CAST(' + d.at('a', 'i') + ' AS DOUBLE) / CASE WHEN na = 0 THEN 1 ELSE na END + ' + d.at('b', 'i') + ' / CASE WHEN nb = 0 THEN 1 ELSE nb END) / 2')} AS u FROM p",
    block_concat=lambda d: f"WITH p AS (SELECT vec_id, a, b, na, nb, {d.each(d.seq(1, d.size('a') + ' + 8'))} AS i FROM blocks2) SELECT vec_id, i AS place, {R('CASE WHEN i <= ' + d.size('a') + ' THEN CAST(' + d.at('a', 'least(i, ' + d.size('a') + ')') + ' AS DOUBLE) / CASE WHEN na = 0 THEN 1 ELSE na END ELSE ' + d.at('b', 'greatest(1, i - ' + d.size('a') + ')') + ' / CASE WHEN nb = 0 THEN 1 ELSE nb END END')} AS u FROM p",
    vector_quality_check=lambda d: f"SELECT count(*) AS n, count(DISTINCT vec_id) AS ids, min({d.size('embedding')}) AS min_dim, max({d.size('embedding')}) AS max_dim, CAST(sum(CASE WHEN nrm = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zeros, CAST(sum(CASE WHEN nrm < 1e300 THEN 0 ELSE 1 END) AS BIGINT) AS not_finite, (SELECT count(*) FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM documents x WHERE x.doc_id = e.vec_id)) AS unknown_ids, (SELECT count(*) FROM documents x WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE x.doc_id = e.vec_id)) AS missing_ids FROM vectors",
    centroid_analysis=lambda d: f"WITH cn AS (SELECT label, sqrt(sum(c * c)) AS cn FROM centroids GROUP BY label), g AS (SELECT x.label, x.i, avg(CASE WHEN quality = 1 THEN u END) AS cp, avg(CASE WHEN quality = 0 THEN u END) AS cq FROM dims x JOIN labels l ON l.doc_id = x.vec_id GROUP BY x.label, x.i), gn AS (SELECT label, sqrt(sum(cp * cp)) AS np, sqrt(sum(cq * cq)) AS nq FROM g GROUP BY label), s AS (SELECT x.vec_id, x.label, round(sum(u * c) / max(cn), 9) AS sim, sum(u * cp) / nullif(max(np), 0) AS pos, sum(u * cq) / nullif(max(nq), 0) AS neg FROM dims x JOIN centroids z ON x.label = z.label AND x.i = z.i JOIN cn ON cn.label = x.label LEFT JOIN g ON g.label = x.label AND g.i = x.i LEFT JOIN gn ON gn.label = x.label GROUP BY x.vec_id, x.label) SELECT vec_id, {R('sim')} AS to_centroid, {R(PCT('sim', 'label'))} AS percentile, {R('pos')} AS to_positive, {R('neg')} AS to_negative, {R('pos - neg')} AS gap FROM s",
    # twenty halvings, each by a hash of its own
    split_half_reference=lambda d: f"WITH g AS (SELECT {d.each(d.seq(1, 20))} AS split), h AS (SELECT label, vec_id, split, CASE WHEN substring(md5(concat(CAST(split AS VARCHAR(3)), '-', CAST(vec_id AS VARCHAR(20)))), 1, 1) < '8' THEN 0 ELSE 1 END AS half FROM (SELECT DISTINCT label, vec_id FROM dims) q CROSS JOIN g), m AS (SELECT h.label, split, half, i, avg(u) AS c FROM h JOIN dims x ON x.vec_id = h.vec_id GROUP BY h.label, split, half, i), p AS (SELECT a.label, a.split, sum(a.c * b.c) / sqrt(sum(a.c * a.c) * sum(b.c * b.c)) AS cos FROM m a JOIN m b ON a.label = b.label AND a.split = b.split AND a.i = b.i WHERE a.half = 0 AND b.half = 1 GROUP BY a.label, a.split) SELECT label, {R('avg(cos)')} AS mean, {R('stddev_samp(cos)')} AS sd, count(*) AS n_splits FROM p GROUP BY label",
    dev_vs_holdout_distance=lambda d: f"WITH m AS (SELECT label, vec_id % 5 = 0 AS held, i, avg(u) AS c FROM dims GROUP BY label, vec_id % 5 = 0, i) SELECT a.label AS dev, b.label AS holdout, {R('sum(a.c * b.c) / nullif(sqrt(sum(a.c * a.c) * sum(b.c * b.c)), 0)')} AS cosine FROM m a JOIN m b ON a.i = b.i WHERE NOT a.held AND b.held GROUP BY a.label, b.label",
    neighbour_leakage=lambda d: f"WITH q AS ({QUERY_COS(d)}), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, vec_id) AS k FROM q WHERE vec_id <> query_id AND c IS NOT NULL), f AS (SELECT query_id, label, count(*) AS n, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, label) AS o FROM k WHERE k <= 25 AND label <> query_label GROUP BY query_id, label) SELECT k.query_id, {R('avg(CASE WHEN k.label <> query_label THEN 1e0 ELSE 0e0 END)')} AS foreign_share, max(f.label) AS top_foreign FROM k LEFT JOIN f ON f.query_id = k.query_id AND o = 1 WHERE k <= 25 GROUP BY k.query_id",
    knn_label_agreement=lambda d: f"WITH q AS ({QUERY_COS(d)}), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, vec_id) AS k FROM q WHERE vec_id <> query_id AND c IS NOT NULL), b AS (SELECT max(n) * 1e0 / sum(n) AS majority FROM (SELECT label, count(*) AS n FROM vectors GROUP BY label) z) SELECT query_id, {R('avg(CASE WHEN label = query_label THEN 1e0 ELSE 0e0 END)')} AS agreement, {R('max(majority)')} AS majority FROM k CROSS JOIN b WHERE k <= 5 GROUP BY query_id",
    brief_transfer_auc=lambda d: f"WITH q AS ({QUERY_COS(d)}), r AS (SELECT q.query_id, q.label, quality AS y, rank() OVER (PARTITION BY q.query_id, q.label ORDER BY round(c, 9)) + (count(*) OVER (PARTITION BY q.query_id, q.label, round(c, 9)) - 1) / 2e0 AS r FROM q JOIN labels l ON l.doc_id = q.vec_id WHERE c IS NOT NULL) SELECT query_id, label, {R('(sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2e0) / nullif(sum(y) * 1e0 * (count(*) - sum(y)), 0)')} AS auc FROM r GROUP BY query_id, label",
    knn_cosine_vote=lambda d: f"WITH q AS ({QUERY_COS(d)}), k AS (SELECT q.*, l.quality, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, vec_id) AS k FROM q JOIN labels l ON l.doc_id = q.vec_id WHERE vec_id <> query_id AND c IS NOT NULL) SELECT query_id, {R('sum(quality / greatest(1 - c, 1e-12)) / sum(1e0 / greatest(1 - c, 1e-12))')} AS proba FROM k WHERE k <= 15 GROUP BY query_id",
    own_best_margin=lambda d: f"WITH q AS (SELECT x.vec_id, x.label, z.label AS other, round(sum(u * c) / nullif(sqrt(sum(c * c)), 0), 9) AS c FROM dims x JOIN centroids z ON x.i = z.i GROUP BY x.vec_id, x.label, z.label) SELECT vec_id, {R('max(CASE WHEN label = other THEN c END) - max(CASE WHEN label <> other THEN c END)')} AS margin, CAST({d.arg_max('other', 'CASE WHEN label <> other THEN c - other * 1e-12 END')} AS INT) AS best_foreign FROM q GROUP BY vec_id",
    coverage_table=lambda d: f"WITH g AS (SELECT i, avg(u) AS mu FROM dims GROUP BY i), c AS (SELECT label, z.i, c - mu AS c FROM centroids z JOIN g ON z.i = g.i), p AS (SELECT a.label AS a, b.label AS b, round(sum(a.c * b.c) / nullif(sqrt(sum(a.c * a.c) * sum(b.c * b.c)), 0), 9) AS s FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY a.label, b.label), m AS (SELECT a AS candidate, max(s) AS nearest, avg(s) AS mean FROM p GROUP BY a) SELECT candidate, {R('nearest')} AS nearest, {R(PCT('nearest', '1'))} AS nearest_pct, {R('mean')} AS mean, CASE WHEN nearest > 0.5 THEN 'covered' WHEN nearest > 0.1 THEN 'near' ELSE 'new' END AS verdict FROM m",
    # labelled rows are scored without themselves, by the closed form; fewer than three kept rows fall back to the mean of all
    rocchio=lambda d: f"WITH l AS (SELECT vec_id, i, u, quality FROM dims JOIN labels l ON l.doc_id = dims.vec_id), m AS (SELECT i, sum(CASE WHEN quality = 1 THEN u ELSE 0 END) AS sp, sum(CASE WHEN quality = 0 THEN u ELSE 0 END) AS sn, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS np, sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS nn FROM l GROUP BY i), g AS (SELECT i, avg(u) AS mu FROM dims GROUP BY i), a AS (SELECT x.vec_id, x.i, x.u, CASE WHEN np - CASE WHEN l.quality = 1 THEN 1 ELSE 0 END < 3 THEN mu ELSE (sp - CASE WHEN l.quality = 1 THEN x.u ELSE 0 END) / nullif(np - CASE WHEN l.quality = 1 THEN 1 ELSE 0 END, 0) - 0.45e0 * coalesce((sn - CASE WHEN l.quality = 0 THEN x.u ELSE 0 END) / nullif(nn - CASE WHEN l.quality = 0 THEN 1 ELSE 0 END, 0), 0) END AS a FROM dims x JOIN m ON m.i = x.i JOIN g ON g.i = x.i LEFT JOIN labels l ON l.doc_id = x.vec_id) SELECT vec_id, {R('sum(u * a) / nullif(sqrt(sum(a * a)), 0)')} AS score FROM a GROUP BY vec_id",
    # a centroid on the dimensions that the pool has in common, less those that are the label's own
    generic_mask_model=lambda d: f"WITH g AS (SELECT i, avg(abs(u)) AS mu FROM dims GROUP BY i), o AS (SELECT label, i, avg(abs(u)) AS mu FROM dims GROUP BY label, i), k AS (SELECT o.label, o.i FROM o JOIN g ON g.i = o.i WHERE o.mu < 1.05e0 * g.mu), c AS (SELECT z.label, z.i, z.c FROM centroids z JOIN k ON k.label = z.label AND k.i = z.i), n AS (SELECT label, sqrt(sum(c * c)) AS n FROM c GROUP BY label) SELECT x.vec_id, count(*) AS dims_used, {R('sum(u * c) / nullif(max(n), 0)')} AS score FROM dims x JOIN c ON c.label = x.label AND c.i = x.i JOIN n ON n.label = x.label GROUP BY x.vec_id",
    participation_ratio_full=lambda d: f"WITH m AS (SELECT i, avg(u) AS mu FROM dims GROUP BY i), x AS (SELECT vec_id, dims.i, u - mu AS z FROM dims JOIN m ON dims.i = m.i), c AS (SELECT a.i, b.i AS j, sum(a.z * b.z) AS c FROM x a JOIN x b ON a.vec_id = b.vec_id GROUP BY a.i, b.i) SELECT {R('power(sum(CASE WHEN i = j THEN c ELSE 0 END), 2) / sum(c * c)', 4)} AS participation FROM c",
    centroid=lambda d: f"SELECT label, i, {R('c')} AS c, n FROM centroids",
    centroid_positive=lambda d: f"SELECT label, i, {R('avg(u)')} AS c FROM dims JOIN labels l ON l.doc_id = dims.vec_id WHERE quality = 1 GROUP BY label, i HAVING count(*) >= 2",
    centroid_similarity=lambda d: f"SELECT a.label AS a, b.label AS b, {R('sum(a.c * b.c) / nullif(sqrt(sum(a.c * a.c) * sum(b.c * b.c)), 0)')} AS cosine FROM centroids a JOIN centroids b ON a.i = b.i GROUP BY a.label, b.label",
    silhouette_cosine=lambda d: f"WITH s AS ({CLASS_SUM}), p AS (SELECT x.vec_id, x.label, s.label AS other, max(n) AS n, sum(u * s.s) AS us FROM dims x JOIN s ON x.i = s.i GROUP BY x.vec_id, x.label, s.label), a AS (SELECT vec_id, max(CASE WHEN label = other AND n > 1 THEN (n - us) / (n - 1e0) END) AS a, min(CASE WHEN label <> other THEN 1 - us / n END) AS b FROM p GROUP BY vec_id) SELECT {R('avg((b - a) / nullif(greatest(a, b), 0))')} AS silhouette FROM a",
    relevance_axis=lambda d: f"WITH m AS (SELECT i, avg(CASE WHEN quality = 1 THEN u END) - avg(CASE WHEN quality = 0 THEN u END) AS a FROM dims JOIN labels l ON l.doc_id = dims.vec_id WHERE vec_id % 5 <> 0 GROUP BY i), n AS (SELECT sqrt(sum(a * a)) AS n FROM m) SELECT vec_id, {R('sum(u * a) / nullif(max(n), 0)')} AS projection FROM dims JOIN m ON dims.i = m.i CROSS JOIN n GROUP BY vec_id",
)
