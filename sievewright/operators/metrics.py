"""Tie-aware, population-weighted ranking metrics and statistics."""

from __future__ import annotations

from ..plans.catalogue import CATALOGUE as C

R = lambda x, n=6: f"round(CAST({x} AS DOUBLE), {n})"
AUC = "(sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2e0) / nullif(sum(y) * 1e0 * (count(*) - sum(y)), 0)"
AT = "s >= 0.5"
CONF = f"sum(CASE WHEN {AT} AND y = 1 THEN w ELSE 0 END) AS tp, sum(CASE WHEN {AT} AND y = 0 THEN w ELSE 0 END) AS fp, sum(CASE WHEN NOT ({AT}) AND y = 1 THEN w ELSE 0 END) AS fn, sum(w) AS w_all"
SAFE = lambda a, b: f"CASE WHEN ({b}) = 0 THEN 0 ELSE ({a}) / ({b}) END"
# first tie block that reaches the target, and the share of it that must be read
TO = lambda target: f"SELECT b.silo, b.cw - b.w AS before, b.w, b.pos, b.cpos - b.pos AS pos_before, t.w_all, {target} AS target, row_number() OVER (PARTITION BY b.silo ORDER BY b.s DESC) AS k FROM blocks b JOIN totals t ON b.silo = t.silo WHERE b.cpos >= {target} AND t.n_pos > 0 AND t.n_neg > 0"
READ = "before + w * (target - pos_before) / (pos * 1e0)"
AVG = lambda v, p: f"rank() OVER (PARTITION BY {p} ORDER BY {v}) + (count(*) OVER (PARTITION BY {p}, {v}) - 1) / 2e0"
FB = lambda b2: f"(CASE WHEN p + r = 0 THEN 0 ELSE (1 + {b2}) * p * r / ({b2} * p + r) END)"
PR = "WITH c AS (SELECT silo, paper_id, k, sum(y) OVER (PARTITION BY silo ORDER BY k) * 1e0 / k AS p, sum(y) OVER (PARTITION BY silo ORDER BY k) * 1e0 / nullif(sum(y) OVER (PARTITION BY silo), 0) AS r FROM ranked)"
MWU = "WITH b AS (SELECT silo, sum(n) AS n, sum(pos) AS n1, sum(CAST(n AS DOUBLE) * n * n - n) AS ties FROM blocks GROUP BY silo), q AS (SELECT silo, sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2e0 AS u FROM ranked GROUP BY silo), m AS (SELECT b.silo, u, n1 * 1e0 AS n1, (n - n1) * 1e0 AS n0, sqrt(n1 * 1e0 * (n - n1) / 12 * (n + 1 - ties / (n * 1e0 * (n - 1)))) AS sd FROM b JOIN q ON q.silo = b.silo WHERE n1 > 0 AND n1 < n)"

CUT = lambda at, w: f"sum(CASE WHEN {at} AND y = 1 THEN {w} ELSE 0 END) AS tp, sum(CASE WHEN {at} THEN {w} ELSE 0 END) AS called, sum(CASE WHEN y = 1 THEN {w} ELSE 0 END) AS real, sum({w}) AS w_all"
ONE = lambda kind, x: f"max(CASE WHEN kind = '{kind}' THEN b.{x} END)"
KIND = lambda k: ", ".join(f"{R(ONE('sweep' if k == 'best' else k, x))} AS {name}_{k}" for x, name in (("p", "prec"), ("r", "rec"), ("f2", "f2"), ("rd", "read")))

C.add(
    roc_auc=lambda d: f"SELECT silo, {R(AUC)} AS auc FROM ranked GROUP BY silo",
    auc_nan_policy=lambda d: f"SELECT silo, CASE WHEN count(*) < 10 OR min(y) = max(y) THEN NULL ELSE {R(AUC)} END AS auc FROM ranked WHERE s IS NOT NULL GROUP BY silo",
    # how well a row's age alone tells the classes apart
    year_auc_flag=lambda d: f"WITH o AS (SELECT l.source AS silo, 1 - b.quality AS y, l.n_chars % 40 AS year FROM documents l JOIN labels b ON b.doc_id = l.doc_id), r AS (SELECT silo, y, {AVG('year', 'silo')} AS r FROM o), a AS (SELECT silo, {AUC} AS auc FROM r GROUP BY silo) SELECT silo, {R('greatest(auc, 1 - auc)')} AS strength, greatest(auc, 1 - auc) > 0.7 AS flagged FROM a",
    average_precision=lambda d: f"SELECT b.silo, {R('sum(pos * 1e0 / nullif(n_pos, 0) * cpos / cn)')} AS ap FROM blocks b JOIN totals t ON b.silo = t.silo GROUP BY b.silo",
    weighted_prf=lambda d: f"WITH c AS (SELECT silo, {CONF} FROM scored GROUP BY silo), p AS (SELECT silo, {SAFE('tp', 'tp + fp')} AS p, {SAFE('tp', 'tp + fn')} AS r, (tp + fp) / w_all AS pos_rate FROM c) SELECT silo, {R('p')} AS prec, {R('r')} AS rec, {R(SAFE('2 * p * r', 'p + r'))} AS f1, {R(SAFE('5 * p * r', '4 * p + r'))} AS f2, {R('pos_rate')} AS pos_rate FROM p",
    precision_recall_f1_f2=lambda d: f"WITH c AS (SELECT silo, sum(CASE WHEN {AT} THEN y ELSE 0 END) * 1e0 AS tp, sum(CASE WHEN {AT} THEN 1 - y ELSE 0 END) AS fp, sum(CASE WHEN NOT ({AT}) THEN y ELSE 0 END) AS fn FROM scored GROUP BY silo) SELECT silo, {R(SAFE('tp', 'tp + fp'))} AS prec, {R(SAFE('tp', 'tp + fn'))} AS rec, {R(SAFE('2 * tp', '2 * tp + fp + fn'))} AS f1, {R(SAFE('5 * tp', '5 * tp + fp + 4 * fn'))} AS f2 FROM c",
    f2_sweep=lambda d: f"WITH g AS (SELECT 'fine' AS grid, x / 1e2 AS t FROM (SELECT {d.each(d.seq(1, 99))} AS x) q UNION ALL SELECT 'coarse', (5 + x) / 1e2 FROM (SELECT {d.each(d.seq(0, 90))} AS x) q), c AS (SELECT grid, silo, t, sum(CASE WHEN s >= t AND y = 1 THEN w ELSE 0 END) AS tp, sum(CASE WHEN s >= t AND y = 0 THEN w ELSE 0 END) AS fp, sum(CASE WHEN s < t AND y = 1 THEN w ELSE 0 END) AS fn FROM (SELECT silo, s, y, sum(w) AS w FROM scored GROUP BY silo, s, y) z CROSS JOIN g GROUP BY grid, silo, t), f AS (SELECT grid, silo, t, {SAFE('5 * tp', '5 * tp + fp + 4 * fn')} AS f2 FROM c) SELECT grid, silo, t AS threshold, {R('f2')} AS f2 FROM (SELECT *, row_number() OVER (PARTITION BY grid, silo ORDER BY round(f2, 9) DESC, t) AS k FROM f) q WHERE k = 1",
    all_positive_f2=lambda d: f"SELECT silo, {R('5 * avg(y * 1e0) / (4 * avg(y * 1e0) + 1)')} AS f2 FROM scored GROUP BY silo",
    tie_frac=lambda d: f"SELECT silo, {R('sum(CASE WHEN n > 1 THEN n ELSE 0 END) * 1e0 / sum(n)')} AS tie_frac FROM blocks GROUP BY silo",
    score_blocks=lambda d: "SELECT silo, round(s, 6) AS s, n, CAST(pos AS BIGINT) AS pos, w FROM blocks",
    wss_weighted=lambda d: f"WITH t AS ({TO('ceil(0.95e0 * t.n_pos)')}) SELECT silo, {R(f'({READ}) / w_all')} AS screened, {R(f'0.95e0 - ({READ}) / w_all')} AS wss FROM t WHERE k = 1",
    recall_at_weighted=lambda d: f"WITH t AS (SELECT b.silo, least(1e0, sum(pos * greatest(0e0, least(1e0, (0.2e0 * t.w_all - (b.cw - b.w)) / b.w))) / max(t.n_pos)) AS recall FROM blocks b JOIN totals t ON b.silo = t.silo WHERE t.n_pos > 0 GROUP BY b.silo) SELECT silo, {R('recall')} AS recall FROM t",
    work_at_own=lambda d: f"WITH c AS (SELECT silo, {CONF} FROM scored GROUP BY silo) SELECT silo, {R('tp / (tp + fn)')} AS recall, {R('(tp + fp) / w_all')} AS screened, {R('1 - (tp + fp) / w_all')} AS saved, {R(SAFE('tp', 'tp + fp'))} AS prec, {R('5 * tp / (5 * tp + fp + 4 * fn)')} AS f2 FROM c WHERE tp + fn > 0",
    # the row at which the 95 % of positives are read, by rows
    ranking_metrics_rows=lambda d: f"WITH c AS (SELECT *, sum(y) OVER (PARTITION BY silo ORDER BY k) AS cy, sum(y) OVER (PARTITION BY silo) AS ny FROM ranked) SELECT silo, {R('sum(CASE WHEN k <= greatest(1, ' + d.half_even('0.1e0 * n') + ') THEN y ELSE 0 END) * 1e0 / nullif(sum(y), 0)')} AS recall_10, {R('sum(CASE WHEN k <= greatest(1, ' + d.half_even('0.2e0 * n') + ') THEN y ELSE 0 END) * 1e0 / nullif(sum(y), 0)')} AS recall_20, {R('0.95e0 - min(CASE WHEN cy >= 0.95e0 * ny AND ny > 0 THEN k END) * 1e0 / max(n)')} AS wss_95 FROM c GROUP BY silo",
    recall_at_10pct=lambda d: f"SELECT silo, {R('sum(CASE WHEN k <= 0.1e0 * n THEN y ELSE 0 END) * 1e0 / nullif(sum(y), 0)')} AS recall FROM ranked GROUP BY silo",
    wss_ceiling=lambda d: f"SELECT silo, {R('0.95e0 * (1 - avg(y * 1e0))')} AS ceiling FROM scored GROUP BY silo",
    cards_to_k=lambda d: f"WITH t AS ({TO('3')}) SELECT silo, {R(READ)} AS cards FROM t WHERE k = 1",
    yield_table=lambda d: f"WITH t AS ({TO('3')}) SELECT t.silo, {R(READ)} AS ranked_cards, {R('3 * (t.w_all + 1) / (n_pos + 1e0)')} AS random_cards, {R('50e0 * 3 / (' + READ + ')')} AS positives_per_50, {R('50e0 * n_pos / t.w_all')} AS random_per_50 FROM t JOIN totals u ON t.silo = u.silo WHERE k = 1",
    pr_curve=lambda d: f"{PR} SELECT silo, paper_id, {R('p')} AS prec, {R('r')} AS rec, {R(FB(1))} AS f1, {R(FB(4))} AS f2, {R('max(p) OVER (PARTITION BY silo ORDER BY k DESC)')} AS clamped FROM c",
    # the named depths: a quarter of the positives, the best F0.5, F1 and F2, nearly all positives; each no shallower than the one before
    pr_points=lambda d: f"{PR}, f AS (SELECT *, {FB(0.25)} AS h, {FB(1)} AS f1, {FB(4)} AS f2 FROM c WHERE r IS NOT NULL), b AS (SELECT silo, min(CASE WHEN r >= 0.25e0 THEN k END) AS quarter, {d.arg_min('k', 'round(-h, 9) * 1e9 + k')} AS k05, {d.arg_min('k', 'round(-f1, 9) * 1e9 + k')} AS k1, {d.arg_min('k', 'round(-f2, 9) * 1e9 + k')} AS k2, min(CASE WHEN r >= 0.95e0 THEN k END) AS nearly FROM f GROUP BY silo) SELECT silo, CAST(quarter AS BIGINT) AS quarter, CAST(greatest(quarter, k05) AS BIGINT) AS best_f05, CAST(greatest(quarter, k05, k1) AS BIGINT) AS best_f1, CAST(greatest(quarter, k05, k1, k2) AS BIGINT) AS best_f2, CAST(greatest(quarter, k05, k1, k2, nearly) AS BIGINT) AS nearly_all FROM b",
    op_points=lambda d: f"{PR}, b AS (SELECT silo, min(CASE WHEN r >= 0.5e0 THEN k END) AS tight, min(CASE WHEN r >= 0.95e0 THEN k END) AS loose, {d.arg_min('k', 'round(-(' + FB(1) + '), 9) * 1e9 + k')} AS f1 FROM c WHERE r IS NOT NULL GROUP BY silo) SELECT silo, CAST(tight AS BIGINT) AS tight, CAST(least(loose, greatest(tight, f1)) AS BIGINT) AS balanced, CAST(loose AS BIGINT) AS loose, tight = loose OR least(loose, greatest(tight, f1)) IN (tight, loose) AS collapsed FROM b",
    boundary_distance=lambda d: f"SELECT paper_id, {R('abs(s - 0.5e0)')} AS distance FROM scored",
    confusion_matrix=lambda d: f"SELECT silo, y, {AT} AS predicted, count(*) AS n FROM scored GROUP BY silo, y, {AT}",
    depth_profile=lambda d: f"WITH b AS (SELECT silo, y, k, row_number() OVER (PARTITION BY silo ORDER BY s2 DESC, paper_id) AS k2, n FROM ranked), g AS (SELECT x / 1e1 AS depth FROM (SELECT {d.each(d.seq(1, 6))} AS x) q) SELECT silo, depth, {R('(sum(CASE WHEN k2 <= depth * n THEN y ELSE 0 END) - sum(CASE WHEN k <= depth * n THEN y ELSE 0 END)) * 1e0 / nullif(sum(y), 0)')} AS gain FROM b CROSS JOIN g GROUP BY silo, depth",
    rank_shift=lambda d: f"WITH p AS (SELECT silo, y, r / n AS a, (rank() OVER (PARTITION BY silo ORDER BY s2) + (count(*) OVER (PARTITION BY silo, s2) - 1) / 2e0) / n AS b FROM ranked) SELECT silo, y, {R('avg(b - a)')} AS shift, {R('avg(CASE WHEN b > a THEN 1e0 ELSE 0e0 END)')} AS share_up FROM p GROUP BY silo, y",
    # pos against neg, and pos against neg and those that nobody labelled
    evaluate_representation=lambda d: f"WITH a AS (SELECT p.lang AS silo, CASE WHEN l.quality IS NULL THEN 0 ELSE 1 - l.quality END AS y, l.quality IS NOT NULL AS known, CAST(n_chars % 97 AS DOUBLE) AS s FROM papers p LEFT JOIN labels l ON l.doc_id = p.paper_id), r AS (SELECT silo, y, known, rank() OVER (PARTITION BY silo ORDER BY s) + (count(*) OVER (PARTITION BY silo, s) - 1) / 2e0 AS r FROM a), c AS (SELECT silo, {AUC} AS auc, sum(CASE WHEN known THEN 1 ELSE 0 END) AS n FROM r GROUP BY silo), t AS (SELECT silo, {AUC} AS auc FROM (SELECT silo, y, rank() OVER (PARTITION BY silo ORDER BY s) + (count(*) OVER (PARTITION BY silo, s) - 1) / 2e0 AS r FROM a WHERE known) q GROUP BY silo) SELECT c.silo, CASE WHEN n >= 6 THEN {R('t.auc')} END AS strict_auc, CASE WHEN n >= 6 THEN {R('c.auc')} END AS conservative_auc FROM c LEFT JOIN t ON t.silo = c.silo",
    macro_recall_wins=lambda d: f"WITH r AS (SELECT silo, sum(CASE WHEN k <= 0.2e0 * n THEN y ELSE 0 END) * 1e0 / nullif(sum(y), 0) AS rec FROM ranked GROUP BY silo) SELECT {R('avg(rec)')} AS macro, CAST(sum(CASE WHEN rec > 0.23 THEN 1 ELSE 0 END) AS BIGINT) AS wins FROM r",
    minmax_rescale=lambda d: f"SELECT paper_id, {R('CASE WHEN max(s) OVER (PARTITION BY silo) = min(s) OVER (PARTITION BY silo) THEN 0 ELSE (s - min(s) OVER (PARTITION BY silo)) / (max(s) OVER (PARTITION BY silo) - min(s) OVER (PARTITION BY silo)) END')} AS z FROM scored",
    calibration_bias=lambda d: f"WITH e AS (SELECT silo, {', '.join(d.pct('s', i / 8) + f' AS e{i}' for i in range(1, 8))} FROM scored GROUP BY silo), x AS (SELECT q.silo, {' + '.join(f'CASE WHEN s > e{i} THEN 1 ELSE 0 END' for i in range(1, 8))} AS bin, y, s FROM scored q JOIN e ON q.silo = e.silo), m AS (SELECT silo, bin, avg(y * 1e0) - avg(s) AS g FROM x GROUP BY silo, bin) SELECT silo, {R('avg(g)')} AS bias FROM m GROUP BY silo",
    brier=lambda d: f"SELECT silo, {R('avg((s - y) * (s - y))')} AS brier FROM scored GROUP BY silo",
    branch_correlation=lambda d: f"SELECT silo, {R('(covar_pop(s, s2) / nullif(sqrt(var_pop(s) * var_pop(s2)), 0))')} AS corr FROM scored GROUP BY silo",
    blend_weight_grid=lambda d: f"WITH g AS (SELECT x / 2e1 AS a FROM (SELECT {d.each(d.seq(0, 20))} AS x) q), r AS (SELECT silo, a, y, rank() OVER (PARTITION BY silo, a ORDER BY round(a * s + (1 - a) * s2, 9)) + (count(*) OVER (PARTITION BY silo, a, round(a * s + (1 - a) * s2, 9)) - 1) / 2e0 AS r FROM scored CROSS JOIN g) SELECT silo, a AS weight, {R(AUC)} AS auc FROM r GROUP BY silo, a",
    # the weight is chosen on one half of the rows and judged on the other
    blend_nested=lambda d: f"WITH g AS (SELECT x / 2e1 AS a FROM (SELECT {d.each(d.seq(0, 20))} AS x) q), z AS (SELECT silo, paper_id % 2 AS half, a, y, round(a * s + (1 - a) * s2, 9) AS v FROM scored CROSS JOIN g), r AS (SELECT silo, half, a, y, rank() OVER (PARTITION BY silo, half, a ORDER BY v) + (count(*) OVER (PARTITION BY silo, half, a, v) - 1) / 2e0 AS r FROM z), c AS (SELECT silo, half, a, {AUC} AS auc FROM r GROUP BY silo, half, a), k AS (SELECT silo, a, row_number() OVER (PARTITION BY silo ORDER BY round(auc, 9) DESC, a) AS k FROM c WHERE half = 0 AND auc IS NOT NULL) SELECT c.silo, c.a AS weight, {R('c.auc')} AS auc FROM c JOIN k ON k.silo = c.silo AND k.a = c.a WHERE k = 1 AND half = 1",
    mann_whitney_u=lambda d: f"{MWU} SELECT silo, {R('u', 4)} AS u, {R('1 - 2 * u / (n1 * n0)')} AS rank_biserial, {R('abs(u - n1 * n0 / 2) / nullif(sd, 0)', 5)} AS z FROM m",
    benjamini_hochberg=lambda d: f"WITH p AS (SELECT paper_id, s AS p, row_number() OVER (ORDER BY s, paper_id) AS r, count(*) OVER () AS m FROM scored WHERE s IS NOT NULL) SELECT paper_id, {R('least(1e0, min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))')} AS q FROM p",
    # pairs of silos are compared only where the silos differ at all: a spread of means beyond that of chance (Kruskal-Wallis against 2 (k - 1))
    bonferroni_pairwise=lambda d: f"WITH r AS (SELECT silo, {AVG('s', '1')} AS r FROM scored), g AS (SELECT silo, count(*) AS n, sum(r) AS sr FROM r GROUP BY silo), h AS (SELECT 12e0 / (sum(n) * (sum(n) + 1)) * sum(sr * sr / n) - 3 * (sum(n) + 1) AS h, count(*) AS k FROM g) SELECT a.silo AS a, b.silo AS b, {R('0.05e0 / nullif(k * (k - 1) / 2e0, 0)')} AS alpha, {R('h', 4)} AS omnibus, h > 2 * (k - 1) AS compared FROM g a JOIN g b ON a.silo < b.silo CROSS JOIN h",
    paired_t=lambda d: f"SELECT silo, {R('avg(s - s2) / (nullif(stddev_samp(s - s2), 0) / sqrt(count(*)))')} AS t FROM scored GROUP BY silo",
    within_group_corr_mean=lambda d: f"WITH r AS (SELECT silo, n, r, rank() OVER (PARTITION BY silo ORDER BY s2) + (count(*) OVER (PARTITION BY silo, s2) - 1) / 2e0 AS r2 FROM ranked), c AS (SELECT silo, (covar_pop(r, r2) / nullif(sqrt(var_pop(r) * var_pop(r2)), 0)) AS c FROM r GROUP BY silo HAVING count(*) >= 50) SELECT {R('avg(c)')} AS mean_rho FROM c",
    # Spearman of the residuals of two rank columns after a linear fit on the control's ranks
    partial_rho=lambda d: f"WITH r AS (SELECT silo, paper_id, {AVG('s', 'silo')} AS a, {AVG('s2', 'silo')} AS b, {AVG('y', 'silo')} AS c FROM scored), f AS (SELECT silo, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, covar_pop(a, c) / nullif(var_pop(c), 0) AS ka, covar_pop(b, c) / nullif(var_pop(c), 0) AS kb FROM r GROUP BY silo), e AS (SELECT r.silo, round(a - ma - coalesce(ka, 0) * (c - mc), 7) AS ea, round(b - mb - coalesce(kb, 0) * (c - mc), 7) AS eb FROM r JOIN f ON r.silo = f.silo), q AS (SELECT silo, {AVG('ea', 'silo')} AS qa, {AVG('eb', 'silo')} AS qb FROM e) SELECT silo, round(CAST((covar_pop(qa, qb) / nullif(sqrt(var_pop(qa) * var_pop(qb)), 0)) AS DOUBLE), 4) AS rho FROM q GROUP BY silo",
    corr_with_label_topk=lambda d: f"WITH r AS (SELECT i, quality * 1e0 AS y, {AVG('u', 'i')} AS r FROM dims JOIN labels l ON l.doc_id = dims.vec_id), c AS (SELECT i, (covar_pop(r, y) / nullif(sqrt(var_pop(r) * var_pop(y)), 0)) AS c FROM r GROUP BY i) SELECT i, {R('c')} AS rho FROM c ORDER BY round(abs(c), 9) DESC, i LIMIT 15",
    jackknife_iqr_min=lambda d: f"WITH v AS (SELECT silo, avg(s) AS m FROM scored GROUP BY silo), j AS (SELECT a.silo AS gone, {d.pct('b.m', 0.75)} - {d.pct('b.m', 0.25)} AS iqr FROM v a JOIN v b ON a.silo <> b.silo GROUP BY a.silo) SELECT {R('min(iqr)')} AS min_iqr FROM j",
    pooled_iqr=lambda d: f"SELECT {R(d.pct('s', 0.75) + ' - ' + d.pct('s', 0.25))} AS iqr, {R(d.pct('s - m', 0.75) + ' - ' + d.pct('s - m', 0.25))} AS centred_iqr FROM (SELECT s, avg(s) OVER (PARTITION BY silo) AS m FROM scored) q",
    loo_spearman=lambda d: f"WITH v AS (SELECT silo, avg(s) AS a, avg(s2) AS b FROM scored GROUP BY silo), r AS (SELECT g.silo AS gone, {AVG('v.a', 'g.silo')} AS a, {AVG('v.b', 'g.silo')} AS b FROM v g JOIN v ON g.silo <> v.silo) SELECT gone, {R('(covar_pop(a, b) / nullif(sqrt(var_pop(a) * var_pop(b)), 0))')} AS rho FROM r GROUP BY gone",
    seed_sd=lambda d: f"WITH f AS (SELECT silo, paper_id % 5 AS seed, avg(s) AS m FROM scored GROUP BY silo, paper_id % 5) SELECT silo, {R('avg(m)')} AS mean, {R('stddev_samp(m)')} AS sd FROM f GROUP BY silo",
    # train, validation and hold-out means of a silo side by side, and the fall between them
    stage_table=lambda d: f"WITH f AS (SELECT silo, CASE WHEN paper_id % 5 < 3 THEN 'train' WHEN paper_id % 5 = 3 THEN 'val' ELSE 'holdout' END AS stage, avg(s) AS m FROM scored GROUP BY 1, 2), w AS (SELECT silo, max(CASE WHEN stage = 'train' THEN m END) AS train, max(CASE WHEN stage = 'val' THEN m END) AS val, max(CASE WHEN stage = 'holdout' THEN m END) AS holdout FROM f GROUP BY silo) SELECT silo, {R('train')} AS train, {R('val')} AS val, {R('holdout')} AS holdout, {R('train - holdout')} AS fall FROM w",
    per_use_case_spread=lambda d: f"WITH m AS (SELECT silo, avg(s) AS a, avg(s2) AS b FROM scored GROUP BY silo) SELECT {R('stddev_samp(a)')} AS sd_before, {R('stddev_samp(b)')} AS sd_after, {R('max(a) - min(a)')} AS range_before, {R('max(b) - min(b)')} AS range_after, {R('min(b)')} AS worst_after FROM m",
    granularity_stats=lambda d: f"WITH g AS (SELECT silo, count(DISTINCT s) AS n_distinct, count(*) AS n, {AUC} AS auc FROM ranked GROUP BY silo HAVING count(*) >= 10), t AS (SELECT silo, sum(CASE WHEN n > 1 THEN n ELSE 0 END) * 1e0 / sum(n) AS tf FROM blocks GROUP BY silo) SELECT g.silo, n_distinct, n, {R('auc')} AS auc, {R('tf')} AS tie_frac FROM g JOIN t ON g.silo = t.silo",
    per_cell_coverage=lambda d: f"SELECT silo, {R('count(s) * 1e0 / count(*)')} AS coverage, CASE WHEN count(s) >= 20 THEN {R('avg(s)')} END AS mean_score FROM scored GROUP BY silo",
    trivial_policy_f2=lambda d: f"SELECT {R('5 * avg(y * 1e0) / (4 * avg(y * 1e0) + 1)')} AS f2, paper_id % 5 AS holdout FROM scored GROUP BY paper_id % 5",
    # arms of a score against the full one, and the worst of three (null if one is missing)
    variant_deltas=lambda d: f"WITH v AS (SELECT silo, y, 'full' AS variant, s AS x FROM scored UNION ALL SELECT silo, y, 'no_s', s2 FROM scored UNION ALL SELECT silo, y, 'coarse', floor(s * 5) FROM scored UNION ALL SELECT silo, y, 'mixed', s * s2 FROM scored), r AS (SELECT silo, variant, y, {AVG('x', 'silo, variant')} AS r FROM v), a AS (SELECT silo, variant, {AUC} AS auc FROM r GROUP BY silo, variant), p AS (SELECT silo, max(CASE WHEN variant = 'full' THEN auc END) AS f, max(CASE WHEN variant = 'no_s' THEN auc END) AS a, max(CASE WHEN variant = 'coarse' THEN auc END) AS b, max(CASE WHEN variant = 'mixed' THEN auc END) AS c FROM a GROUP BY silo) SELECT silo, {R('a - f')} AS d_no_s, {R('b - f')} AS d_coarse, {R('c - f')} AS d_mixed, CASE WHEN a + b + c IS NOT NULL THEN {R('least(a, b, c) - f')} END AS worst FROM p",
    # everything a report row has: ranking, the cut at one half, the best of 99 cuts (ties: the lowest), the verdict that came with the scores; silos of one class give none
    score_row_bundle=lambda d: f"WITH a AS (SELECT silo, count(*) AS n, {AUC} AS auc, avg(y * 1e0) AS prev FROM ranked GROUP BY silo), p AS (SELECT b.silo, sum(pos * 1e0 / nullif(n_pos, 0) * cpos / cn) AS ap, sum(CASE WHEN n > 1 THEN n ELSE 0 END) * 1e0 / sum(n) AS tf, least(1e0, sum(pos * greatest(0e0, least(1e0, (0.1e0 * t.w_all - (b.cw - b.w)) / b.w))) / nullif(max(t.n_pos), 0)) AS rc FROM blocks b JOIN totals t ON b.silo = t.silo GROUP BY b.silo), t AS ({TO('ceil(0.95e0 * t.n_pos)')}), ws AS (SELECT silo, 0.95e0 - ({READ}) / w_all AS wss FROM t WHERE k = 1), g AS (SELECT x / 1e2 AS t FROM (SELECT {d.each(d.seq(1, 99))} AS x) q), z AS (SELECT silo, s, y, sum(w) AS w FROM scored GROUP BY silo, s, y), m AS (SELECT silo, 'half' AS kind, 0.5e0 AS t, {CUT('s >= 0.5', 'w')} FROM scored GROUP BY silo UNION ALL SELECT silo, 'own', NULL, {CUT('s2 >= 0.5', 'w')} FROM scored GROUP BY silo UNION ALL SELECT silo, 'sweep', t, {CUT('s >= t', 'w')} FROM z CROSS JOIN g GROUP BY silo, t), f AS (SELECT silo, kind, t, {SAFE('tp', 'called')} AS p, {SAFE('tp', 'real')} AS r, {SAFE('5 * tp', '4 * real + called')} AS f2, called / w_all AS rd, real / w_all AS share FROM m), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY silo, kind ORDER BY round(f2, 9) DESC, t) AS k FROM f) q WHERE k = 1) SELECT a.silo, max(a.n) AS n, {R('max(auc)')} AS auc, {R('max(prev)')} AS prevalence, {R('max(ap)')} AS ap, {R('max(wss)')} AS wss, {R('max(tf)')} AS tie_frac, {R('max(rc)')} AS recall_10, {R('max(5 * share / (4 * share + 1))')} AS floor_f2, {', '.join(KIND(k) for k in ('half', 'best', 'own'))}, {R(ONE('sweep', 't'))} AS t_star FROM a JOIN p ON p.silo = a.silo JOIN b ON b.silo = a.silo LEFT JOIN ws ON ws.silo = a.silo WHERE a.auc IS NOT NULL GROUP BY a.silo",
)
