"""Compile-time integrity, dedup, sampling and fold design."""

from __future__ import annotations

from ..plans.catalogue import CATALOGUE as C
from .inputs import NORM

R = lambda x, n=6: f"round(CAST({x} AS DOUBLE), {n})"
DRAW = lambda key, seed=42: f"md5(concat('{seed}-', CAST({key} AS VARCHAR(20))))"
TITLE = lambda d: NORM(d, "title")

#: A stand-in for an identifier that some papers have.
DOI = "CASE WHEN paper_id % 3 = 0 THEN concat('10.1/', upper(substring(md5(text), 1, 12))) WHEN paper_id % 3 = 1 THEN ' ' END"

C.add(
    registry_check=lambda d: "SELECT b.silo, 'no papers' AS issue FROM briefs b WHERE NOT EXISTS (SELECT 1 FROM papers p WHERE p.silo = b.silo) UNION ALL SELECT DISTINCT p.silo, 'no brief' FROM papers p WHERE NOT EXISTS (SELECT 1 FROM briefs b WHERE b.silo = p.silo)",
    build_use_case_frame=lambda d: f"SELECT concat(silo, '__', CAST(paper_id AS VARCHAR(20))) AS row_key, silo AS use_case_key, nullif(trim(title), '') AS title, nullif(trim(abstract), '') AS abstract, nullif(trim(abstract), '') IS NOT NULL AS has_abstract, lower(trim(lang)) AS language, {DOI} AS doi, 1990 + n_chars % 35 AS year, CASE WHEN l.quality = 1 THEN 'relevant' WHEN l.quality = 0 THEN 'not_relevant' END AS review_label FROM papers p LEFT JOIN labels l ON l.doc_id = p.paper_id",
    # every column, by label: how many are missing, and their share
    missingness_table=lambda d: "WITH x AS (SELECT lang, coalesce(CAST(quality AS VARCHAR(9)), 'none') AS label, nullif(trim(title), '') AS title, nullif(trim(abstract), '') AS abstract, quality, toxic FROM papers p LEFT JOIN labels l ON l.doc_id = p.paper_id), m AS (" + " UNION ALL ".join(f"SELECT lang, label, '{c}' AS col, CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS gone FROM x" for c in ("title", "abstract", "quality", "toxic")) + ") SELECT lang, label, col, CAST(sum(gone) AS BIGINT) AS missing, round(avg(gone * 1e0), 6) AS share FROM m GROUP BY lang, label, col",
    paper_identity=lambda d: f"SELECT paper_id, CASE WHEN trim(coalesce({DOI}, '')) <> '' THEN concat('doi:', lower(trim({DOI}))) WHEN {TITLE(d)} <> '' THEN concat('ttl:', {TITLE(d)}) ELSE concat('id:', CAST(paper_id AS VARCHAR(20))) END AS identity FROM papers",
    # identities on both sides of a split by the silos' order
    crossing_papers=lambda d: f"WITH o AS (SELECT silo, rank() OVER (ORDER BY silo) <= (count(*) OVER ()) / 2 AS early FROM (SELECT DISTINCT silo FROM papers) q) SELECT {TITLE(d)} AS k, count(DISTINCT early) AS sides, count(*) AS n FROM papers p JOIN o ON o.silo = p.silo WHERE {TITLE(d)} <> '' GROUP BY {TITLE(d)} HAVING count(DISTINCT early) > 1",
    cross_doi_leak=lambda d: f"SELECT lower(trim({DOI})) AS doi, count(DISTINCT silo) AS silos, count(DISTINCT y) AS answers FROM labelled WHERE trim(coalesce({DOI}, '')) <> '' AND y IS NOT NULL GROUP BY lower(trim({DOI})) HAVING count(DISTINCT silo) > 1",
    # the name that a key is shown by is its most frequent spelling
    author_frequency=lambda d: f"WITH a AS (SELECT trim(a) AS name, lower(trim(a)) AS author FROM (SELECT {d.each(d.split('title', ','))} AS a FROM papers) q WHERE trim(a) <> ''), c AS (SELECT author, name, count(*) AS n FROM a GROUP BY author, name), k AS (SELECT author, name, sum(n) OVER (PARTITION BY author) AS n, row_number() OVER (PARTITION BY author ORDER BY n DESC, name) AS k FROM c) SELECT author, name, CAST(n AS BIGINT) AS n FROM k WHERE k = 1",
    # rows, columns without a value, infinite values, blocks that are null together, widths of vectors
    feature_sanity=lambda d: f"SELECT count(*) AS n, CAST(sum(CASE WHEN s IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_s, count(s) = 0 AS all_null, CAST(sum(CASE WHEN abs(s) < 1e300 THEN 0 WHEN s IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS infinite, CAST(sum(CASE WHEN (s IS NULL) <> (s2 IS NULL) THEN 1 ELSE 0 END) AS BIGINT) AS half_blocks, (SELECT count(DISTINCT {d.size('embedding')}) FROM embeddings) AS widths FROM scored",
    # the groups of columns that go out, what is left behind, mean null rate of each group
    output_contract=lambda d: "WITH m AS (SELECT avg(CASE WHEN s IS NULL THEN 1e0 ELSE 0e0 END) AS s, avg(CASE WHEN s2 IS NULL THEN 1e0 ELSE 0e0 END) AS s2, avg(CASE WHEN w IS NULL THEN 1e0 ELSE 0e0 END) AS w, avg(CASE WHEN y IS NULL THEN 1e0 ELSE 0e0 END) AS y FROM scored) SELECT 'scores' AS col_group, 's,s2' AS cols, round((s + s2) / 2, 6) AS null_rate, false AS dropped FROM m UNION ALL SELECT 'label', 'y', round(y, 6), false FROM m UNION ALL SELECT 'weights', 'w', round(w, 6), true FROM m",
    # the sample's weighted AUC and prevalence against the population's
    sampling_gate=lambda d: f"WITH r AS (SELECT silo, y, s, row_number() OVER (PARTITION BY silo, y ORDER BY {DRAW('paper_id')}, paper_id) AS k, count(*) OVER (PARTITION BY silo, y) AS n FROM scored), t AS (SELECT silo, y, s, CASE WHEN y = 1 THEN 1e0 ELSE n * 1e0 / least(n, 30) END AS w FROM r WHERE y = 1 OR k <= 30), b AS (SELECT silo, s, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS p, sum(CASE WHEN y = 0 THEN w ELSE 0 END) AS q FROM t GROUP BY silo, s), u AS (SELECT silo, p, q, sum(q) OVER (PARTITION BY silo ORDER BY s) - q AS below FROM b), a AS (SELECT silo, sum(p * (below + q / 2)) / nullif(sum(p) * sum(q), 0) AS auc, sum(p) / nullif(sum(p) + sum(q), 0) AS prev FROM u GROUP BY silo), f AS (SELECT silo, (sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2e0) / nullif(sum(y) * 1e0 * (count(*) - sum(y)), 0) AS auc, avg(y * 1e0) AS prev FROM ranked GROUP BY silo) SELECT f.silo, {R('f.auc')} AS auc, {R('a.auc')} AS sample_auc, {R('f.prev')} AS prevalence, {R('a.prev')} AS sample_prevalence, abs(f.auc - a.auc) < 0.03 AND abs(f.prev - a.prev) < 0.005 AS passed FROM f JOIN a ON a.silo = f.silo",
    # all bipartitions of the silos but mirror images, balanced to within one, least links first
    min_leak_partition=lambda d: f"WITH t AS (SELECT DISTINCT lang AS silo, split_part(title, ' ', 1) AS k FROM papers), n AS (SELECT silo, row_number() OVER (ORDER BY silo) - 1 AS b, count(*) OVER () AS n FROM (SELECT DISTINCT silo FROM t) q), e AS (SELECT x.b AS a, y.b AS b, count(*) AS w FROM t p JOIN t q ON p.k = q.k AND p.silo < q.silo JOIN n x ON x.silo = p.silo JOIN n y ON y.silo = q.silo GROUP BY x.b, y.b), z AS (SELECT max(n) AS n FROM n), m AS (SELECT n, {d.each(d.seq(1, 'CAST(power(2, n - 1) - 1 AS BIGINT)' if d.name == 'duckdb' else 'CAST(power(2, n - 1) - 1 AS BIGINT)')) if d.name == 'duckdb' else 'explode(sequence(1L, CAST(power(2, n - 1) - 1 AS BIGINT)))'} AS mask FROM z), s AS (SELECT m.mask, sum(CAST(floor(mask / power(2, n.b)) AS BIGINT) % 2) AS ones, max(m.n) AS n FROM m CROSS JOIN n GROUP BY m.mask), k AS (SELECT s.mask, CAST(coalesce(sum(CASE WHEN CAST(floor(s.mask / power(2, a)) AS BIGINT) % 2 <> CAST(floor(s.mask / power(2, b)) AS BIGINT) % 2 THEN w ELSE 0 END), 0) AS BIGINT) AS cut FROM s CROSS JOIN e WHERE abs(2 * ones - s.n) <= 1 GROUP BY s.mask) SELECT mask, cut FROM k ORDER BY cut, mask LIMIT 1",
    negative_policy=lambda d: f"WITH r AS (SELECT paper_id, silo, row_number() OVER (PARTITION BY silo ORDER BY s DESC, paper_id) AS hard, row_number() OVER (PARTITION BY silo ORDER BY s, paper_id) AS easy, row_number() OVER (PARTITION BY silo ORDER BY {DRAW('paper_id')}, paper_id) AS rnd FROM scored WHERE y = 0) SELECT paper_id, silo, 'hard' AS policy FROM r WHERE hard <= 10 UNION ALL SELECT paper_id, silo, 'easy' FROM r WHERE easy <= 10 UNION ALL SELECT paper_id, silo, 'mixed' FROM r WHERE hard <= 5 OR easy <= 5 UNION ALL SELECT paper_id, silo, 'random' FROM r WHERE rnd <= 10",
    # every card that nobody labelled, in order of rank, with a control from the labelled ones at each place 9 + 7 n
    deal_batch=lambda d: "WITH r AS (SELECT doc_id AS paper_id, lang AS silo, row_number() OVER (PARTITION BY lang ORDER BY n_chars % 97 DESC, doc_id) AS k FROM documents p WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = p.doc_id)), c AS (SELECT doc_id AS paper_id, lang AS silo, row_number() OVER (PARTITION BY lang ORDER BY n_chars % 97, doc_id) AS k FROM documents p WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = p.doc_id)), m AS (SELECT silo, max(k) AS cards FROM r GROUP BY silo) SELECT paper_id, silo, CAST(k + CASE WHEN k >= 9 THEN floor((k - 9) / 6e0) + 1 ELSE 0 END AS BIGINT) AS place, false AS control FROM r UNION ALL SELECT paper_id, c.silo, CAST(9 + 7 * (k - 1) AS BIGINT), true FROM c JOIN m ON m.silo = c.silo WHERE 8 + 6 * (k - 1) < cards",
    fold_viability=lambda d: "WITH f AS (SELECT silo, paper_id % 5 AS fold, CAST(sum(y) AS BIGINT) AS p FROM scored GROUP BY silo, paper_id % 5) SELECT silo, min(p) AS min_pos, min(p) >= 3 AND count(*) = 5 AS viable FROM f GROUP BY silo",
    # outside reviews have no term lists: their overlaps are null, their labels stand
    external_reviews=lambda d: f"SELECT l.doc_id AS paper_id, concat('ext_', lang) AS use_case_key, {d.size(d.strings())} AS n_terms, CASE WHEN {d.size(d.strings())} = 0 THEN NULL ELSE 0 END AS overlap, 1 - quality AS y FROM documents p JOIN labels l ON l.doc_id = p.doc_id",
    # the one fill with 0, which stands beside its indicator
    label_and_fill_excl=lambda d: f"WITH b AS (SELECT silo, CASE WHEN item_id % 2 = 0 THEN exclude ELSE {d.strings()} END AS ex FROM briefs), x AS (SELECT l.paper_id, l.y, b.ex, CASE WHEN {d.size('b.ex')} > 0 THEN {d.both(d.distinct('t.ts'), 'b.ex')} * 1e0 / {d.size('b.ex')} END AS frac FROM labelled l JOIN paper_tokens t ON t.paper_id = l.paper_id JOIN b ON b.silo = l.silo) SELECT paper_id, y, round(coalesce(frac, 0), 6) AS overlap_excl_frac, {d.size('ex')} > 0 AS has_exclude_terms FROM x",
    lean_blocks=lambda d: f"SELECT paper_id, 2026 - (1990 + n_chars % 35) AS age, CASE WHEN trim(title) = '' THEN 1 ELSE {d.size(d.split('title', ','))} END AS n_authors, CASE WHEN trim(abstract) <> '' THEN 1 ELSE 0 END AS has_abstract, {R('ln(1 + n_chars)')} AS log_citations FROM papers",
    has_abstract=lambda d: f"SELECT paper_id, {d.size(d.find('abstract', '[^ \\t\\n\\r]+'))} > 0 AS has_abstract FROM papers",
    manifest_verify=lambda d: f"SELECT p.silo, count(*) AS n, {R('avg(l.quality * 1e0)', 4)} AS prevalence, {R('count(nullif(abstract, chr(0))) * 1e0 / count(*)', 3)} AS coverage FROM papers p LEFT JOIN labels l ON l.doc_id = p.paper_id GROUP BY p.silo".replace("nullif(abstract, chr(0))", "nullif(abstract, '')"),
    key_uniqueness=lambda d: "SELECT silo, count(*) AS n, count(DISTINCT paper_id) AS keys FROM papers GROUP BY silo",
    same_paper_two_answers=lambda d: "SELECT md5(text) AS k, count(DISTINCT silo) AS silos, count(DISTINCT y) AS answers FROM labelled GROUP BY md5(text) HAVING count(DISTINCT silo) > 1",
    null_vs_blank_audit=lambda d: "SELECT CAST(sum(CASE WHEN abstract IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls, CAST(sum(CASE WHEN trim(abstract) = '' THEN 1 ELSE 0 END) AS BIGINT) AS blanks, count(*) AS n FROM papers",
    brief_constant_check=lambda d: f"SELECT silo, count(DISTINCT {d.join('must', '|')}) AS n FROM briefs GROUP BY silo HAVING count(DISTINCT {d.join('must', '|')}) = 1",
    dedup_within_silo=lambda d: f"WITH f AS (SELECT paper_id, silo, row_number() OVER (PARTITION BY silo, {TITLE(d)} ORDER BY paper_id) AS k, row_number() OVER (PARTITION BY silo, md5(text) ORDER BY paper_id) AS k2 FROM papers) SELECT paper_id, silo FROM f WHERE k = 1 AND k2 = 1",
    cross_silo_dups_info=lambda d: "SELECT paper_id, count(*) OVER (PARTITION BY md5(text)) AS copies FROM papers",
    sharing_matrix=lambda d: f"WITH i AS (SELECT DISTINCT silo, {TITLE(d)} AS k FROM papers WHERE {TITLE(d)} <> '') SELECT a.silo AS a, b.silo AS b, count(*) AS shared FROM i a JOIN i b ON a.k = b.k AND a.silo < b.silo GROUP BY a.silo, b.silo",
    title_leak_check=lambda d: f"WITH t AS (SELECT DISTINCT lang, silo, {TITLE(d)} AS k FROM papers) SELECT a.silo, count(DISTINCT a.k) AS leaked FROM t a JOIN t b ON a.k = b.k AND a.silo <> b.silo GROUP BY a.silo",
    # equal titles first become one row; a row with a = b tells of its copies
    fuzzy_title_pairs=lambda d: f"WITH t AS (SELECT lang, k, min(paper_id) AS paper_id, count(*) AS copies FROM (SELECT paper_id, lang, {d.sub(TITLE(d), '[^a-z0-9 ]', '')} AS k FROM papers) q GROUP BY lang, k), p AS (SELECT a.paper_id AS a, b.paper_id AS b, a.copies AS copies_a, b.copies AS copies_b, 1 - {d.edit('a.k', 'b.k')} * 1e0 / greatest(length(a.k), length(b.k), 1) AS sim FROM t a JOIN t b ON a.lang = b.lang AND (a.paper_id < b.paper_id OR a.paper_id = b.paper_id AND a.copies > 1)) SELECT a, b, copies_a, copies_b, {R('sim', 4)} AS sim FROM p WHERE round(sim, 9) >= 0.85e0",
    first_author=lambda d: "SELECT paper_id, CASE WHEN trim(split_part(title, ',', 1)) = '' THEN concat('no_author_', CAST(paper_id AS VARCHAR(20))) ELSE lower(trim(split_part(title, ',', 1))) END AS first_author FROM papers",
    n_authors=lambda d: f"SELECT paper_id, CASE WHEN trim(title) <> '' THEN {d.size(d.split('title', ','))} END AS n_authors FROM papers",
    paper_age_velocity=lambda d: f"SELECT o_orderkey, greatest(0, 2000 - year(o_orderdate)) AS age, {R('o_totalprice / (greatest(0, 2000 - year(o_orderdate)) + 1)', 4)} AS velocity FROM orders",
    export_slim=lambda d: "SELECT paper_id, silo, y, s FROM scored".replace("s FROM", "round(s, 6) AS s FROM"),
    case_control_sample=lambda d: f"WITH r AS (SELECT paper_id, silo, y, row_number() OVER (PARTITION BY silo, y ORDER BY {DRAW('paper_id')}, paper_id) AS k, count(*) OVER (PARTITION BY silo, y) AS n FROM scored) SELECT paper_id, silo, y, CASE WHEN y = 1 THEN 1e0 ELSE {R('n * 1e0 / least(n, 30)')} END AS w FROM r WHERE y = 1 OR k <= 30",
    stratified_kfold=lambda d: "WITH k AS (SELECT silo, least(5, sum(y), count(*) - sum(y)) AS k FROM scored GROUP BY silo), r AS (SELECT paper_id, silo, row_number() OVER (PARTITION BY silo, y ORDER BY paper_id) - 1 AS r FROM scored) SELECT paper_id, CASE WHEN k >= 2 THEN CAST(r % k AS BIGINT) END AS fold FROM r JOIN k ON r.silo = k.silo",
    logo_rotation=lambda d: "SELECT silo AS holdout, count(*) AS n_test, CAST(sum(count(*)) OVER () - count(*) AS BIGINT) AS n_train FROM scored GROUP BY silo",
    tier_assignment=lambda d: "SELECT silo, CASE WHEN n_pos >= 40 THEN 'core' WHEN n_pos >= 10 THEN 'thin' ELSE 'quarantine' END AS tier FROM totals",
    few_shot_select=lambda d: f"SELECT fold, paper_id, silo, y FROM (SELECT fold, paper_id, silo, y, row_number() OVER (PARTITION BY fold, silo, y ORDER BY {DRAW('paper_id', 7)}, paper_id) AS k FROM scored CROSS JOIN (SELECT {d.each(d.seq(0, 4))} AS fold) g WHERE paper_id % 5 <> fold) q WHERE k <= 2",
    proportional_stratified_subsample=lambda d: f"SELECT paper_id, silo, y FROM (SELECT paper_id, silo, y, row_number() OVER (PARTITION BY silo, y ORDER BY {DRAW('paper_id')}, paper_id) AS k, count(*) OVER (PARTITION BY silo, y) AS n FROM scored) q WHERE k <= greatest(1, {d.half_even('n * 0.1e0')})",
    use_case_index=lambda d: f"SELECT silo, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, {R('avg(y * 1e0)')} AS prevalence FROM scored GROUP BY silo",
    population_match=lambda d: "SELECT coalesce(a.silo, b.silo) AS silo, a.n AS have, b.n AS want FROM (SELECT lang AS silo, count(*) AS n FROM documents GROUP BY lang) a FULL OUTER JOIN (SELECT silo, count(*) AS n FROM scored GROUP BY silo) b ON a.silo = b.silo WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)",
)
