"""Plain readings of plans whose distributed form is built otherwise: row by row, by self joins and correlated counts. For the oracle only."""

from __future__ import annotations

from ..plans.catalogue import CATALOGUE as C
from . import integrity, lexical, metrics, ranking, relational, screening  # noqa: F401  the plans come first
from .inputs import NORM

R = lambda x, n=6: f"round(CAST({x} AS DOUBLE), {n})"
TOKEN_LIST = "regexp_extract_all(trim(regexp_replace(translate(lower(coalesce(x, '')), '-/', '  '), '[ \\t\\n\\r]+', ' ', 'g')), '[a-z0-9]+')"
TITLES = lambda d: f"SELECT min(paper_id) AS paper_id, silo, y, count(*) AS copies, list_distinct(regexp_extract_all(k, '[a-z0-9]+')) AS ts FROM (SELECT paper_id, silo, y, {NORM(d, 'title')} AS k FROM labelled) q GROUP BY silo, y, k"
MEAN_RANK = lambda v: f"(SELECT count(*) FROM x o WHERE o.{v} < x.{v}) + ((SELECT count(*) FROM x o WHERE o.{v} = x.{v}) + 1) / 2.0"

C.plain(
    rank_in_reference=lambda d: f"SELECT t.doc_id, {R('avg(CASE WHEN r.n_chars <= t.n_chars THEN 1.0 ELSE 0.0 END)')} AS share FROM documents t LEFT JOIN (SELECT lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) r ON r.lang = t.lang GROUP BY t.doc_id",
    asof_join=lambda d: "SELECT p.event_id, arg_max(v.event_id, (v.ts, v.event_id)) AS last_view FROM events p JOIN events v ON p.user_id = v.user_id AND v.event_type = 'view' AND v.ts <= p.ts WHERE p.event_type = 'purchase' GROUP BY p.event_id",
    pct_rank_train_ref=lambda d: f"SELECT a.paper_id, {R('avg(CASE WHEN b.s <= a.s THEN 1.0 ELSE 0.0 END)')} AS share FROM scored a LEFT JOIN scored b ON a.silo = b.silo AND a.paper_id % 5 <> b.paper_id % 5 GROUP BY a.paper_id",
    logo_rotation=lambda d: "SELECT h.silo AS holdout, count(*) FILTER (s.silo = h.silo) AS n_test, count(*) FILTER (s.silo <> h.silo) AS n_train FROM scored s CROSS JOIN (SELECT DISTINCT silo FROM scored) h GROUP BY h.silo",
    corr_pearson_spearman=lambda d: f"WITH x AS (SELECT quality AS a, n_chars AS b FROM documents d JOIN labels l ON d.doc_id = l.doc_id), r AS (SELECT a, b, {MEAN_RANK('a')} AS ra, {MEAN_RANK('b')} AS rb FROM x) SELECT {R('corr(a, b)')} AS pearson, {R('corr(ra, rb)')} AS spearman FROM r",
    conflict_dup=lambda d: f"WITH t AS ({TITLES(d)}) SELECT a.paper_id AS a, b.paper_id AS b, a.copies AS copies_a, b.copies AS copies_b FROM t a JOIN t b ON a.silo = b.silo AND a.y = 1 AND b.y = 0 WHERE len(list_intersect(a.ts, b.ts)) > 0 AND len(list_intersect(a.ts, b.ts)) * 1.0 / len(list_distinct(list_concat(a.ts, b.ts))) >= 0.55",
    # the rank sum as a count of ordered pairs, ties half
    roc_auc=lambda d: f"SELECT k.silo, z.auc FROM (SELECT DISTINCT silo FROM scored) k LEFT JOIN (SELECT p.silo, {R('avg(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0.0 END)')} AS auc FROM scored p JOIN scored n ON p.silo = n.silo AND p.y = 1 AND n.y = 0 GROUP BY p.silo) z ON z.silo = k.silo",
    cold_start=lambda d: f"SELECT k.silo, z.auc FROM (SELECT DISTINCT silo FROM scored) k LEFT JOIN (SELECT p.silo, {R('avg(CASE WHEN p.s2 > n.s2 THEN 1.0 WHEN p.s2 = n.s2 THEN 0.5 ELSE 0.0 END)')} AS auc FROM scored p JOIN scored n ON p.silo = n.silo AND p.y = 1 AND n.y = 0 GROUP BY p.silo) z ON z.silo = k.silo",
    mann_whitney_u=lambda d: f"WITH z AS (SELECT silo, n1 * 1e0 AS n1, (n - n1) * 1e0 AS n0, sqrt(n1 * 1e0 * (n - n1) / 12 * (n + 1 - t / (n * 1e0 * (n - 1)))) AS sd FROM (SELECT silo, sum(c) AS n, sum(p) AS n1, sum(c::DOUBLE * c * c - c) AS t FROM (SELECT silo, s, count(*) AS c, sum(y) AS p FROM scored GROUP BY ALL) GROUP BY silo)) SELECT p.silo, {R('abs(sum(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0.0 END) - any_value(z.n1 * z.n0) / 2) / any_value(z.sd)', 5)} AS z, {R('sum(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0.0 END)', 4)} AS u, {R('1 - 2 * avg(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0.0 END)')} AS rank_biserial FROM scored p JOIN scored n ON p.silo = n.silo AND p.y = 1 AND n.y = 0 JOIN z ON z.silo = p.silo GROUP BY p.silo",
    # pair by pair in place of the closed form over sums of unit vectors
    pairwise_cosine_mean=lambda d: f"SELECT a.label, {R('avg(' + d.dot('a.embedding', 'b.embedding') + ' / (a.nrm * b.nrm))')} AS mean_cosine FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id < b.vec_id WHERE a.nrm > 0 AND b.nrm > 0 GROUP BY a.label",
    silhouette_cosine=lambda d: f"WITH p AS (SELECT a.vec_id, a.label, b.label AS other, avg(1 - {d.dot('a.embedding', 'b.embedding')} / (a.nrm * b.nrm)) AS dist FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id WHERE a.nrm > 0 AND b.nrm > 0 GROUP BY a.vec_id, a.label, b.label), q AS (SELECT vec_id, min(CASE WHEN label = other THEN dist END) AS a, min(CASE WHEN label <> other THEN dist END) AS b FROM p GROUP BY vec_id) SELECT {R('avg((b - a) / greatest(a, b))')} AS silhouette FROM q",
    pct_rank=lambda d: f"SELECT a.paper_id, {R('(count(*) FILTER (b.s < a.s) + (count(*) FILTER (b.s = a.s) + 1) / 2.0) / count(*)')} AS pr FROM scored a JOIN scored b ON a.silo = b.silo GROUP BY a.paper_id",
    average_precision=lambda d: f"SELECT k.silo, z.ap FROM (SELECT DISTINCT silo FROM scored) k LEFT JOIN (WITH t AS (SELECT a.silo, a.paper_id, count(*) AS above, sum(b.y) AS hits FROM scored a JOIN scored b ON a.silo = b.silo AND b.s >= a.s WHERE a.y = 1 GROUP BY a.silo, a.paper_id) SELECT silo, {R('avg(hits * 1.0 / above)')} AS ap FROM t GROUP BY silo) z ON z.silo = k.silo",
)

# Metrics: what stands above a row counted row by row, AUC as the share of ordered pairs, precision and recall by their definitions.
PAIRS = lambda rows, by, v: f"SELECT {by}, avg(CASE WHEN p.{v} > n.{v} THEN 1.0 WHEN p.{v} = n.{v} THEN 0.5 ELSE 0.0 END) AS auc FROM ({rows}) p JOIN ({rows}) n USING ({by}) WHERE p.y = 1 AND n.y = 0 GROUP BY {by}"
TIES = """t AS (SELECT DISTINCT silo, s FROM scored), z AS (SELECT t.silo, t.s, (SELECT coalesce(sum(w), 0) FROM scored o WHERE o.silo = t.silo AND o.s > t.s) AS above, (SELECT sum(w) FROM scored o WHERE o.silo = t.silo AND o.s = t.s) AS own,
(SELECT coalesce(sum(y), 0) FROM scored o WHERE o.silo = t.silo AND o.s > t.s) AS found, (SELECT sum(y) FROM scored o WHERE o.silo = t.silo AND o.s = t.s) AS more FROM t),
g AS (SELECT silo, sum(w) AS w_all, sum(y) AS n_pos, count(*) - sum(y) AS n_neg FROM scored GROUP BY silo)"""
PAR = "c AS (SELECT silo, sum({w}) FILTER (s >= 0.5 AND y = 1) AS tp, sum({w}) FILTER (s >= 0.5) AS called, sum({w}) FILTER (y = 1) AS real, sum({w}) AS every FROM scored GROUP BY silo), p AS (SELECT silo, coalesce(tp / nullif(called, 0), 0) AS p, coalesce(tp / nullif(real, 0), 0) AS r, coalesce(called, 0) / every AS share FROM c)"
F_OF = lambda b2: f"coalesce((1 + {b2}) * p * r / nullif({b2} * p + r, 0), 0)"
AVERAGE = lambda t, v: f"(SELECT count(*) FILTER (o.{v} < {t}.{v}) + (count(*) FILTER (o.{v} = {t}.{v}) + 1) / 2.0 FROM {t} o WHERE o.silo = {t}.silo)"
UNIT = lambda t: f"[x::DOUBLE / {t}.nrm FOR x IN {t}.embedding]"

C.plain(
    wss_weighted=lambda d: f"WITH {TIES} SELECT silo, {R('(above + own * (ceil(0.95 * n_pos) - found) / more) / w_all')} AS screened, {R('0.95 - (above + own * (ceil(0.95 * n_pos) - found) / more) / w_all')} AS wss FROM z JOIN g USING (silo) WHERE n_neg > 0 AND found < ceil(0.95 * n_pos) AND found + more >= ceil(0.95 * n_pos)",
    cards_to_k=lambda d: f"WITH {TIES} SELECT silo, {R('above + own * (3 - found) / more')} AS cards FROM z JOIN g USING (silo) WHERE n_neg > 0 AND found < 3 AND found + more >= 3",
    recall_at_weighted=lambda d: f"WITH {TIES} SELECT silo, {R('least(1, sum(more * greatest(0, least(1, (0.2 * w_all - above) / own))) / any_value(n_pos))')} AS recall FROM z JOIN g USING (silo) WHERE n_pos > 0 GROUP BY silo",
    tie_frac=lambda d: f"SELECT silo, {R('avg((EXISTS (SELECT 1 FROM scored o WHERE o.silo = a.silo AND o.s = a.s AND o.paper_id <> a.paper_id))::INT)')} AS tie_frac FROM scored a GROUP BY silo",
    weighted_prf=lambda d: f"WITH {PAR.format(w='w')} SELECT silo, {R('p')} AS prec, {R('r')} AS rec, {R(F_OF(1))} AS f1, {R(F_OF(4))} AS f2, {R('share')} AS pos_rate FROM p",
    precision_recall_f1_f2=lambda d: f"WITH {PAR.format(w='1.0')} SELECT silo, {R('p')} AS prec, {R('r')} AS rec, {R(F_OF(1))} AS f1, {R(F_OF(4))} AS f2 FROM p",
    f2_sweep=lambda d: f"""WITH g AS (SELECT 'fine' AS grid, unnest([i / 100 FOR i IN range(1, 100)]) AS t UNION ALL SELECT 'coarse', unnest([(i + 5) / 100 FOR i IN range(0, 91)])),
c AS (SELECT grid, t, silo, sum(w) FILTER (s >= t AND y = 1) AS tp, sum(w) FILTER (s >= t) AS called, sum(w) FILTER (y = 1) AS real FROM scored CROSS JOIN g GROUP BY ALL), p AS (SELECT grid, t, silo, coalesce(tp / nullif(called, 0), 0) AS p, coalesce(tp / nullif(real, 0), 0) AS r FROM c),
f AS (SELECT grid, t, silo, {F_OF(4)} AS f2 FROM p) SELECT grid, silo, min(t) AS threshold, {R('max(f2)')} AS f2 FROM f JOIN (SELECT grid, silo, max(round(f2, 9)) AS best FROM f GROUP BY ALL) USING (grid, silo) WHERE round(f2, 9) = best GROUP BY grid, silo""",
    all_positive_f2=lambda d: f"WITH c AS (SELECT silo, sum(y) / count(*) AS p, CASE WHEN sum(y) > 0 THEN 1.0 ELSE 0.0 END AS r FROM scored GROUP BY silo) SELECT silo, {R(F_OF(4))} AS f2 FROM c",
    auc_nan_policy=lambda d: f"WITH a AS ({PAIRS('SELECT silo, y, s FROM scored WHERE s IS NOT NULL', 'silo', 's')}) SELECT silo, CASE WHEN count(*) >= 10 THEN {R('any_value(auc)')} END AS auc FROM scored LEFT JOIN a USING (silo) WHERE s IS NOT NULL GROUP BY silo",
    year_auc_flag=lambda d: f"WITH o AS (SELECT source AS silo, 1 - quality AS y, n_chars % 40 AS year FROM documents JOIN labels USING (doc_id)), a AS ({PAIRS('SELECT * FROM o', 'silo', 'year')}), k AS (SELECT DISTINCT silo FROM o) SELECT silo, {R('greatest(auc, 1 - auc)')} AS strength, greatest(auc, 1 - auc) > 0.7 AS flagged FROM k LEFT JOIN a USING (silo)",
    blend_weight_grid=lambda d: f"WITH m AS (SELECT silo, y, i, silo || '|' || i AS cell, round(i / 20 * s + (1 - i / 20) * s2, 9) AS v FROM scored CROSS JOIN (SELECT unnest(range(0, 21)) AS i)), a AS ({PAIRS('SELECT cell, y, v FROM m', 'cell', 'v')}) SELECT k.silo, i / 20 AS weight, {R('auc')} AS auc FROM (SELECT DISTINCT silo, i, cell FROM m) k LEFT JOIN a USING (cell)",
    branch_correlation=lambda d: f"SELECT silo, CASE WHEN count(DISTINCT s) > 1 AND count(DISTINCT s2) > 1 THEN {R('corr(s, s2)')} END AS corr FROM scored GROUP BY silo",
    within_group_corr_mean=lambda d: f"WITH scored_rows AS (SELECT silo, s, s2 FROM scored), r AS (SELECT silo, {AVERAGE('scored_rows', 's')} AS a, {AVERAGE('scored_rows', 's2')} AS b FROM scored_rows), c AS (SELECT silo, corr(a, b) AS c FROM r GROUP BY silo HAVING count(*) >= 50) SELECT {R('avg(c)')} AS mean_rho FROM c",
    partial_rho=lambda d: f"""WITH b AS (SELECT silo, paper_id, s, s2, y FROM scored), r AS (SELECT silo, paper_id, {AVERAGE('b', 's')} AS a, {AVERAGE('b', 's2')} AS b, {AVERAGE('b', 'y')} AS c FROM b),
f AS (SELECT silo, regr_slope(a, c) AS ka, regr_slope(b, c) AS kb, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc FROM r GROUP BY silo), e AS (SELECT r.silo, round(a - ma - coalesce(if(isfinite(ka), ka, NULL), 0) * (c - mc), 7) AS ea, round(b - mb - coalesce(if(isfinite(kb), kb, NULL), 0) * (c - mc), 7) AS eb FROM r JOIN f USING (silo)),
q AS (SELECT silo, {AVERAGE('e', 'ea')} AS qa, {AVERAGE('e', 'eb')} AS qb FROM e) SELECT silo, round(corr(qa, qb), 4) AS rho FROM q GROUP BY silo""",
    jackknife_iqr_min=lambda d: f"WITH v AS (SELECT silo, avg(s) AS m FROM scored GROUP BY silo), l AS (SELECT list(m ORDER BY silo) AS m FROM v), j AS (SELECT unnest([list_aggregate(list_concat(m[:i - 1], m[i + 1:]), 'quantile_cont', 0.75) - list_aggregate(list_concat(m[:i - 1], m[i + 1:]), 'quantile_cont', 0.25) FOR i IN range(1, len(m) + 1)]) AS iqr FROM l) SELECT {R('min(iqr)')} AS min_iqr FROM j",
    pct_rank_ordinal=lambda d: f"SELECT a.paper_id, {R('count(b.paper_id) / nullif((SELECT count(*) FROM scored c WHERE c.silo = a.silo) - 1, 0)')} AS pr FROM scored a LEFT JOIN scored b ON b.silo = a.silo AND (b.s < a.s OR b.s = a.s AND b.paper_id < a.paper_id) GROUP BY a.paper_id, a.silo",
    tier_assignment=lambda d: "SELECT silo, CASE WHEN count(*) FILTER (y = 1) < 10 THEN 'quarantine' WHEN count(*) FILTER (y = 1) < 40 THEN 'thin' ELSE 'core' END AS tier FROM scored GROUP BY silo",
    case_control_sample=lambda d: f"WITH r AS (SELECT a.paper_id, a.silo, a.y, (SELECT count(*) FROM scored b WHERE b.silo = a.silo AND b.y = a.y AND (md5('42-' || b.paper_id), b.paper_id) < (md5('42-' || a.paper_id), a.paper_id)) AS before, (SELECT count(*) FROM scored b WHERE b.silo = a.silo AND b.y = a.y) AS n FROM scored a) SELECT paper_id, silo, y, CASE WHEN y = 1 THEN 1 ELSE {R('n / least(n, 30)')} END AS w FROM r WHERE y = 1 OR before < 30",
    sampling_gate=lambda d: f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY silo, y ORDER BY md5('42-' || paper_id), paper_id) AS k, count(*) OVER (PARTITION BY silo, y) AS n FROM scored), t AS (SELECT silo, y, s, CASE WHEN y = 1 THEN 1.0 ELSE n / least(n, 30) END AS w FROM r WHERE y = 1 OR k <= 30),
a AS (SELECT p.silo, sum(p.w * n.w * CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0.0 END) / sum(p.w * n.w) AS auc FROM t p JOIN t n ON p.silo = n.silo AND p.y = 1 AND n.y = 0 GROUP BY p.silo), b AS (SELECT silo, sum(w) FILTER (y = 1) / sum(w) AS prev FROM t GROUP BY silo), f AS ({PAIRS('SELECT silo, y, s FROM scored', 'silo', 's')}), g AS (SELECT silo, avg(y) AS prev FROM scored GROUP BY silo)
SELECT g.silo, {R('f.auc')} AS auc, {R('a.auc')} AS sample_auc, {R('g.prev')} AS prevalence, {R('b.prev')} AS sample_prevalence, abs(f.auc - a.auc) < 0.03 AND abs(g.prev - b.prev) < 0.005 AS passed FROM g JOIN b USING (silo) LEFT JOIN f USING (silo) LEFT JOIN a USING (silo)""",
)

VERDICT = lambda name, at: f"{name} AS (SELECT silo, coalesce(sum(w) FILTER ({at} AND y = 1), 0) / nullif(coalesce(sum(w) FILTER ({at}), 0), 0) AS p0, coalesce(sum(w) FILTER ({at} AND y = 1), 0) / sum(w) FILTER (y = 1) AS r, coalesce(sum(w) FILTER ({at}), 0) / sum(w) AS rd FROM scored GROUP BY silo), {name}_f AS (SELECT silo, coalesce(p0, 0) AS p, r, rd FROM {name})"
COLUMNS = lambda t, k: f"{R(f'{t}.p')} AS prec_{k}, {R(f'{t}.r')} AS rec_{k}, {R(f'coalesce(5 * {t}.p * {t}.r / nullif(4 * {t}.p + {t}.r, 0), 0)')} AS f2_{k}, {R(f'{t}.rd')} AS read_{k}"
C.plain(
    score_row_bundle=lambda d: f"""WITH {TIES}, a AS ({PAIRS('SELECT silo, y, s FROM scored', 'silo', 's')}), w95 AS (SELECT silo, 0.95 - (above + own * (ceil(0.95 * n_pos) - found) / more) / w_all AS wss FROM z JOIN g USING (silo) WHERE found < ceil(0.95 * n_pos) AND found + more >= ceil(0.95 * n_pos)),
rc AS (SELECT silo, sum(more * greatest(0, least(1, (0.1 * w_all - above) / own))) / any_value(n_pos) AS rc FROM z JOIN g USING (silo) GROUP BY silo), ap AS (SELECT silo, avg(hits / n) AS ap FROM (SELECT p.silo, p.paper_id, count(*) AS n, sum(o.y) AS hits FROM scored p JOIN scored o ON p.silo = o.silo AND o.s >= p.s WHERE p.y = 1 GROUP BY ALL) GROUP BY silo),
tf AS (SELECT silo, avg((EXISTS (SELECT 1 FROM scored o WHERE o.silo = x.silo AND o.s = x.s AND o.paper_id <> x.paper_id))::INT) AS tf FROM scored x GROUP BY silo), {VERDICT('half', 's >= 0.5')}, {VERDICT('mine', 's2 >= 0.5')},
cuts AS (SELECT unnest([i / 100 FOR i IN range(1, 100)]) AS t), sw AS (SELECT silo, t, coalesce(coalesce(sum(w) FILTER (s >= t AND y = 1), 0) / nullif(coalesce(sum(w) FILTER (s >= t), 0), 0), 0) AS p, coalesce(sum(w) FILTER (s >= t AND y = 1), 0) / sum(w) FILTER (y = 1) AS r, coalesce(sum(w) FILTER (s >= t), 0) / sum(w) AS rd FROM scored CROSS JOIN cuts GROUP BY ALL),
best AS (SELECT DISTINCT ON (silo) * FROM sw ORDER BY silo, round(coalesce(5 * p * r / nullif(4 * p + r, 0), 0), 9) DESC, t), pr AS (SELECT silo, count(*) AS n, avg(y) AS prev, sum(w) FILTER (y = 1) / sum(w) AS share FROM scored GROUP BY silo)
SELECT silo, n, {R('auc')} AS auc, {R('prev')} AS prevalence, {R('ap')} AS ap, {R('wss')} AS wss, {R('tf')} AS tie_frac, {R('rc')} AS recall_10, {R('5 * share / (4 * share + 1)')} AS floor_f2, {COLUMNS('half_f', 'half')}, {COLUMNS('best', 'best')}, {COLUMNS('mine_f', 'own')}, {R('best.t')} AS t_star
FROM pr JOIN a USING (silo) LEFT JOIN w95 USING (silo) JOIN rc USING (silo) JOIN ap USING (silo) JOIN tf USING (silo) JOIN half_f USING (silo) JOIN mine_f USING (silo) JOIN best USING (silo)""",
)

# Words and titles: a term is looked up by itself, a shared title counted by its holders.
C.plain(
    overlap_score=lambda d: f"""WITH h AS (SELECT paper_id, p.silo, [t FOR t IN must IF list_contains(ts, t)] AS m, [t FOR t IN nice IF list_contains(ts, t)] AS n, [t FOR t IN exclude IF list_contains(ts, t)] AS e, must, nice FROM paper_tokens p JOIN briefs b USING (silo))
SELECT paper_id, silo, round(coalesce(len(m) / nullif(len(must), 0), 0) + 0.5 * coalesce(len(n) / nullif(len(nice), 0), 0) - least(len(e), 1), 6) AS overlap FROM h""",
    term_hit_rate=lambda d: f"SELECT b.silo, {R('avg((EXISTS (SELECT 1 FROM terms t WHERE t.paper_id = p.paper_id AND list_contains(b.must, t.term)))::INT)')} AS hit_rate FROM papers p JOIN briefs b USING (silo) GROUP BY b.silo",
    phrase_match=lambda d: """WITH t AS (SELECT silo, unnest(list_concat([{'field': 'must', 'term': x} FOR x IN must], [{'field': 'nice', 'term': x} FOR x IN nice], [{'field': 'exclude', 'term': x} FOR x IN exclude], [{'field': 'pair', 'term': must[1] || '  ' || must[2]}])) AS t FROM briefs),
w AS (SELECT silo, t.field AS field, t.term AS term, string_split_regex(trim(t.term), ' +') AS ws FROM t), k AS (SELECT paper_id, silo, unnest(ts) AS tok, generate_subscripts(ts, 1) AS i FROM paper_tokens),
h AS (SELECT DISTINCT a.paper_id, field, term FROM w JOIN k a ON a.silo = w.silo AND a.tok = ws[1] LEFT JOIN k b ON b.paper_id = a.paper_id AND b.i = a.i + 1 WHERE len(ws) = 1 OR len(ws) = 2 AND b.tok = ws[2])
SELECT p.paper_id, w.field, w.term, h.term IS NOT NULL AS hit FROM papers p JOIN w USING (silo) LEFT JOIN h ON h.paper_id = p.paper_id AND h.field = w.field AND h.term = w.term""",
    negation_aware_exclude=lambda d: f"""WITH s AS (SELECT paper_id, silo, row_number() OVER () AS sid, x FROM (SELECT paper_id, silo, unnest(string_split_regex(text, '[.!?]+')) AS x FROM papers)), w AS (SELECT paper_id, silo, sid, unnest({TOKEN_LIST}) AS term, generate_subscripts({TOKEN_LIST}, 1) AS i FROM s)
SELECT paper_id, term, count(*) AS hits, count(*) FILTER (NOT EXISTS (SELECT 1 FROM w c WHERE c.sid = w.sid AND c.i BETWEEN w.i - 6 AND w.i - 1 AND c.term IN ('no', 'not', 'non', 'without', 'excluding', 'except', 'never', 'neither', 'nor'))) AS live_hits FROM w JOIN briefs b ON b.silo = w.silo AND list_contains(b.exclude, w.term) GROUP BY paper_id, term""",
    title_jaccard=lambda d: f"""WITH t AS (SELECT paper_id, silo, n_chars, list_distinct(regexp_extract_all({NORM(d, 'title')}, '[a-z0-9]+')) AS ts FROM papers), m AS (SELECT DISTINCT ON (silo) silo, paper_id AS seed, ts AS other FROM t ORDER BY silo, n_chars DESC, paper_id)
SELECT paper_id, seed, {R("coalesce(len(list_intersect(ts, other)) / nullif(len(list_distinct(list_concat(ts, other))), 0), 0)")} AS jaccard FROM t JOIN m USING (silo)""",
    sharing_matrix=lambda d: f"WITH k AS (SELECT {NORM(d, 'title')} AS k, list(DISTINCT silo ORDER BY silo) AS s FROM papers GROUP BY 1), p AS (SELECT unnest(flatten([[{{'a': x, 'b': y}} FOR y IN s IF y > x] FOR x IN s])) AS p FROM k WHERE k <> '') SELECT p.a AS a, p.b AS b, count(*) AS shared FROM p GROUP BY ALL",
    title_leak_check=lambda d: f"WITH k AS (SELECT {NORM(d, 'title')} AS k, list(DISTINCT silo) AS s FROM papers GROUP BY 1) SELECT silo, count(*) AS leaked FROM (SELECT k, unnest(s) AS silo FROM k WHERE len(s) > 1) GROUP BY silo",
    cross_doi_leak=lambda d: "WITH l AS (SELECT '10.1/' || md5(text)[1:12] AS doi, silo, y FROM labelled WHERE paper_id % 3 = 0 AND y IS NOT NULL) SELECT doi, count(DISTINCT silo) AS silos, count(DISTINCT y) AS answers FROM l GROUP BY doi HAVING min(silo) <> max(silo)",
    crossing_papers=lambda d: f"WITH o AS (SELECT list(DISTINCT silo ORDER BY silo) AS s FROM papers), t AS (SELECT {NORM(d, 'title')} AS k, list_position(s, silo) * 2 <= len(s) AS early FROM papers, o) SELECT k, 2 AS sides, count(*) AS n FROM t WHERE k <> '' GROUP BY k HAVING bool_or(early) AND NOT bool_and(early)",
    first_author=lambda d: "SELECT paper_id, coalesce(nullif(lower(trim(string_split(title, ',')[1])), ''), 'no_author_' || paper_id) AS first_author FROM papers",
)

# Vectors: every pair of unit vectors.
C.plain(
    centroid_similarity=lambda d: f"WITH u AS (SELECT label, {UNIT('v')} AS u FROM vectors v WHERE nrm > 0), s AS (SELECT a.label AS a, b.label AS b, sum({d.dot('a.u', 'b.u')}) AS s FROM u a CROSS JOIN u b GROUP BY ALL) SELECT s.a, s.b, {R('s.s / sqrt(x.s * y.s)')} AS cosine FROM s JOIN s x ON x.a = s.a AND x.b = s.a JOIN s y ON y.a = s.b AND y.b = s.b",
    cosine_to_brief=lambda d: f"""WITH c AS (SELECT v.vec_id, q.vec_id AS query_id, CASE WHEN v.nrm > 0 AND q.nrm > 0 THEN round({d.dot('v.embedding', 'q.embedding')} / (v.nrm * q.nrm), 9) END AS c FROM vectors v JOIN vectors q ON q.vec_id % 100 = 0)
SELECT a.vec_id, a.query_id, {R('any_value(a.c)')} AS cosine, CASE WHEN any_value(a.c) IS NOT NULL THEN {R('(count(*) FILTER (b.c < a.c) + (count(*) FILTER (b.c = a.c) + 1) / 2.0) / count(b.c)')} END AS pr FROM c a JOIN c b USING (query_id) GROUP BY a.vec_id, a.query_id""",
    brief_transfer_auc=lambda d: f"""WITH c AS (SELECT q.vec_id AS query_id, v.label, quality AS y, q.vec_id || '|' || v.label AS cell, round({d.dot('v.embedding', 'q.embedding')} / (v.nrm * q.nrm), 9) AS c FROM vectors v JOIN vectors q ON q.vec_id % 100 = 0 AND v.nrm > 0 AND q.nrm > 0 JOIN labels ON doc_id = v.vec_id),
a AS ({PAIRS('SELECT cell, y, c FROM c', 'cell', 'c')}) SELECT query_id, label, {R('any_value(auc)')} AS auc FROM c LEFT JOIN a USING (cell) GROUP BY query_id, label""",
)
