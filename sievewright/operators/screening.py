"""Spec quality, screening responses and consistency detectors."""

from __future__ import annotations

from ..plans.catalogue import CATALOGUE as C
from .inputs import NORM, TOKENS

#: Jaccard similarity from which two titles count as one.
TITLE_BOUND = "0.55e0"
R = lambda x, n=6: f"round(CAST({x} AS DOUBLE), {n})"

KEYED = "concat('{\"messages\":[{\"content\":\"', clean, '\",\"role\":\"', role, '\"}],\"model\":\"m\"}')"
ARMS = lambda d: "m AS (SELECT silo, coalesce(lead(silo) OVER (ORDER BY md5(silo)), first_value(silo) OVER (ORDER BY md5(silo))) AS donor FROM briefs)"
FIELDS = lambda d: {f: (lambda t, f=f: f"{t}.{f}") for f in ("obj", "prob", "dom")} | {f: (lambda t, f=f: d.join(f"{t}.{f}", "|")) for f in ("must", "nice", "exclude")}
FIELD_NAMES = [f"'{f}'" for f in ("obj", "prob", "dom", "must", "nice", "exclude")]
RENDER = lambda d, gone="": "concat_ws(' ', " + ", ".join(("''" if f == gone else e("briefs")) for f, e in FIELDS(d).items()) + ")"
PHRASE = lambda d: f"""WITH df AS (SELECT silo, term, count(*) AS df FROM (SELECT silo, {d.each(d.distinct('ts'))} AS term FROM paper_tokens) z GROUP BY silo, term), n AS (SELECT silo, count(*) AS n FROM papers GROUP BY silo),
t AS (SELECT silo, concat({d.at('must', 1)}, ' ', {d.at('must', 2)}) AS phrase FROM briefs), w AS (SELECT silo, phrase, {d.each(d.split('phrase', ' '))} AS term FROM t),
g AS (SELECT w.silo, w.phrase, {d.arg_min('w.term', 'CASE WHEN df.df IS NOT NULL THEN ' + d.pair('df.df', 'w.term') + ' END')} AS rarest, min(df.df * 1e0 / n.n) AS share, count(df.df) AS known, {d.join(d.gather('w.term', 'w.term'), ' ')} AS every FROM w JOIN n ON n.silo = w.silo LEFT JOIN df ON df.silo = w.silo AND df.term = w.term GROUP BY w.silo, w.phrase)"""  # noqa: E731
KEY = "CASE WHEN known = 0 THEN NULL WHEN share < 0.25 THEN rarest ELSE every END"
COS = lambda d: f"SELECT v.vec_id, q.vec_id AS query_id, round({d.dot('v.embedding', 'q.embedding')} / nullif(v.nrm * q.nrm, 0), 9) AS c FROM vectors v CROSS JOIN (SELECT * FROM vectors WHERE vec_id % 100 = 0) q"  # the stated query set
RETRIEVED = "WITH v AS (VECTORS), r AS (SELECT query_id, 1 - quality AS y, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS k, count(*) OVER (PARTITION BY query_id) AS n, rank() OVER (PARTITION BY query_id ORDER BY c) + (count(*) OVER (PARTITION BY query_id, c) - 1) / 2e0 AS r FROM v JOIN labels l ON l.doc_id = v.vec_id WHERE c IS NOT NULL), c AS (SELECT *, sum(y) OVER (PARTITION BY query_id ORDER BY k) AS cy, sum(y) OVER (PARTITION BY query_id) AS ny FROM r)"
AUC_R = "(sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2e0) / nullif(sum(y) * 1e0 * (count(*) - sum(y)), 0)"

C.add(
    near_duplicate_term=lambda d: f"WITH t AS (SELECT silo, 'must' AS field, {d.each('must')} AS term FROM briefs UNION ALL SELECT silo, 'nice', {d.each('nice')} FROM briefs UNION ALL SELECT silo, 'full', concat({d.at('must', 1)}, ' (', {d.at('nice', 1)}, ')') FROM briefs), n AS (SELECT silo, field, term, trim({d.sub('lower(term)', '[(][^)]*[)]', '')}) AS k FROM t) SELECT DISTINCT a.silo, a.term AS a, b.term AS b FROM n a JOIN n b ON a.silo = b.silo AND (a.field <> b.field OR a.term <> b.term) AND b.k <> '' AND contains(a.k, b.k)",
    # the other arm's brief is that of the next silo in hashed order; null-safe, field by field
    arm_diff=lambda d: f"WITH {ARMS(d)} SELECT a.silo, x.field FROM briefs a JOIN m ON m.silo = a.silo JOIN briefs b ON b.silo = m.donor CROSS JOIN (SELECT {d.each(d.array(*FIELD_NAMES))} AS field) x WHERE CASE x.field " + " ".join(f"WHEN '{f}' THEN {e('a')} IS DISTINCT FROM {e('b')}" for f, e in FIELDS(d).items()) + " END",
    brief_swap=lambda d: f"WITH {ARMS(d)}, s AS (SELECT * FROM m WHERE silo <> 'src3') SELECT a.silo, {', '.join(f'coalesce({e(chr(98))}, {chr(39)}{chr(39)}) AS {f}' for f, e in FIELDS(d).items())} FROM briefs a LEFT JOIN s ON s.silo = a.silo LEFT JOIN briefs b ON b.silo = s.donor",
    # only the term lists come from the other arm
    decompose_arm=lambda d: f"WITH {ARMS(d)} SELECT a.silo, a.obj, a.prob, {d.join('b.must', '|')} AS must, {d.join('b.nice', '|')} AS nice, {d.join('b.exclude', '|')} AS exclude, a.dom FROM briefs a JOIN m ON m.silo = a.silo JOIN briefs b ON b.silo = m.donor",
    # a hash per variant and silo; a variant that renders like the full brief is an error of the variant
    brief_hash_distinct=lambda d: f"WITH v AS (SELECT silo, 'full' AS variant, {RENDER(d)} AS body FROM briefs UNION ALL SELECT silo, 'no_obj', {RENDER(d, 'obj')} FROM briefs UNION ALL SELECT silo, 'no_must', {RENDER(d, 'must')} FROM briefs UNION ALL SELECT silo, 'no_dom', {RENDER(d, 'dom')} FROM briefs), h AS (SELECT silo, variant, substring({d.sha('body')}, 1, 8) AS sha FROM v) SELECT a.silo, a.variant, a.sha, a.variant <> 'full' AND a.sha = b.sha AS like_full FROM h a JOIN h b ON a.silo = b.silo AND b.variant = 'full'",
    # keys that repeat, required texts that are blank, anchors that no brief has
    brief_catalogue_checks=lambda d: "WITH c AS (SELECT silo, obj, dom FROM briefs UNION ALL SELECT 'src1', '', 'x'), a AS (SELECT silo, CASE WHEN length(silo) = 4 THEN 'src1' ELSE 'none' END AS anchor FROM briefs) SELECT silo, 'duplicate key' AS issue FROM c GROUP BY silo HAVING count(*) > 1 UNION ALL SELECT silo, 'no objective' FROM c WHERE trim(coalesce(obj, '')) = '' UNION ALL SELECT silo, 'unknown anchor' FROM a WHERE NOT EXISTS (SELECT 1 FROM briefs b WHERE b.silo = a.anchor)",
    # a readiness span always is a predicate
    trl_range_span=lambda d: f"WITH t AS (SELECT conv_id, turn, concat(text, CASE WHEN conv_id % 3 = 0 THEN ' TRL 4-6.' ELSE '' END) AS text FROM conversations) SELECT conv_id, turn, {d.like('text', '(?i)trl ?[0-9]+ ?[-–] ?[0-9]+')} AS predicate, CASE WHEN {d.like('text', '(?i)trl ?[0-9]+ ?[-–] ?[0-9]+')} THEN 'trl_range' ELSE 'none' END AS rule FROM t",
    # bars that were set beforehand, per silo
    bar_verdict=lambda d: "WITH b AS (SELECT DISTINCT silo, CASE WHEN silo = 'en' THEN 0.45e0 ELSE 0.5e0 END AS bar FROM scored) SELECT s.silo, max(bar) AS bar, CASE WHEN avg(s) >= max(bar) THEN 'pass' WHEN count(s) = 0 THEN 'no data' ELSE 'fail' END AS verdict FROM scored s JOIN b ON b.silo = s.silo GROUP BY s.silo",
    # the prompt with the silo's brief, or with the override given for a silo
    build_prompt=lambda d: f"WITH o AS (SELECT 'src2' AS silo, 'Only field trials.' AS override) SELECT p.paper_id, concat('Brief: ', coalesce(o.override, b.obj), chr(10), CASE WHEN o.override IS NULL THEN concat('Must: ', {d.join('b.must', ', ')}, chr(10), 'Nice: ', {d.join('b.nice', ', ')}, chr(10), 'Exclude: ', {d.join('b.exclude', ', ')}, chr(10)) ELSE '' END, 'Title: ', p.title, chr(10), 'Abstract: ', p.abstract) AS prompt FROM papers p JOIN briefs b ON p.silo = b.silo LEFT JOIN o ON o.silo = p.silo",
    # the request as JSON with its keys in order
    cache_key=lambda d: f"SELECT conv_id, turn, {d.sha(KEYED)} AS k FROM (SELECT conv_id, turn, role, {d.sub('text', '[^a-zA-Z0-9 ]', '')} AS clean FROM conversations) q",
    # requests that a cache of the even conversations would answer, median price of the others, projection
    dry_run_cost=lambda d: f"WITH r AS (SELECT DISTINCT md5(text) AS k, length(text) / 4e0 * 1e-6 AS price FROM conversations), h AS (SELECT DISTINCT md5(text) AS k FROM conversations WHERE conv_id % 2 = 0), m AS (SELECT r.k, price, h.k IS NOT NULL AS hit FROM r LEFT JOIN h ON h.k = r.k) SELECT count(*) AS calls, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS hits, {R('avg(CASE WHEN hit THEN 1e0 ELSE 0e0 END)')} AS hit_rate, {R(d.pct('price', 0.5), 9)} AS unit_cost, {R('sum(CASE WHEN hit THEN 0 ELSE 1 END) * ' + d.pct('price', 0.5), 7)} AS projected FROM m",
    # the rarest word that the pool knows if it is in under a quarter of the papers, else all known words; null without one
    phrase_key=lambda d: f"{PHRASE(d)} SELECT silo, phrase, {KEY} AS k FROM g",
    phrase_strong=lambda d: f"{PHRASE(d)}, k AS (SELECT silo, phrase, {KEY} AS k FROM g), x AS (SELECT p.paper_id, {TOKENS(d, 'p.title')} AS title, t.ts, k.phrase, k.k, {d.split('k.phrase', ' ')} AS ws FROM papers p JOIN paper_tokens t ON t.paper_id = p.paper_id JOIN k ON k.silo = p.silo) SELECT paper_id, phrase, coalesce({d.both('title', d.split('k', ' '))} > 0, false) OR {d.both(d.distinct('ts'), 'ws')} = {d.size(d.distinct('ws'))} AS strong FROM x",
    # what is typed, in any case, two characters or more; five per group, none that is chosen already
    autocomplete=lambda d: f"WITH q AS (SELECT {d.each(d.array(*[f'{chr(39)}{x}{chr(39)}' for x in ('TH', 'er', 'x', 'ion')]))} AS typed), t AS (SELECT DISTINCT lang, term FROM (SELECT p.lang, {d.each(d.distinct('k.ts'))} AS term FROM paper_tokens k JOIN papers p ON p.paper_id = k.paper_id) z), c AS (SELECT DISTINCT m AS term FROM (SELECT {d.each('must')} AS m FROM briefs) z), h AS (SELECT typed, lang, t.term, row_number() OVER (PARTITION BY typed, lang ORDER BY length(t.term), t.term) AS k FROM t JOIN q ON length(typed) >= 2 AND contains(t.term, lower(typed)) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.term = t.term)) SELECT typed, lang, term FROM h WHERE k <= 5",
    # opens at 25 seen with a quarter rejected, and again after 12 more
    suggestion_gate=lambda d: "WITH r AS (SELECT silo, k, sum(1 - y) OVER (PARTITION BY silo ORDER BY k) AS rejects FROM ranked), o AS (SELECT silo, k, min(k) OVER (PARTITION BY silo) AS first_k FROM r WHERE k >= 25 AND rejects >= 0.25 * k) SELECT silo, CAST(k AS BIGINT) AS opens FROM o WHERE (k - first_k) % 12 = 0",
    conflict_spec_kept=lambda d: f"WITH h AS (SELECT l.silo, l.paper_id FROM labelled l JOIN paper_tokens t ON t.paper_id = l.paper_id JOIN briefs b ON b.silo = l.silo WHERE l.y = 1 AND {d.both(d.distinct('t.ts'), 'b.exclude')} > 0) SELECT silo, count(*) AS kept, count(*) >= 3 AS conflict FROM h GROUP BY silo",
    conflict_spec_rejected=lambda d: f"SELECT l.silo, count(*) AS n, CASE WHEN count(*) >= 4 THEN 'strong' WHEN count(*) >= 2 THEN 'conflict' ELSE 'none' END AS tier FROM labelled l JOIN paper_tokens t ON t.paper_id = l.paper_id JOIN briefs b ON b.silo = l.silo WHERE l.y = 0 AND {d.both(d.distinct('t.ts'), 'b.must')} > 0 AND {d.both(d.distinct('t.ts'), 'b.nice')} > 0 GROUP BY l.silo",
    # append-only, the latest stands; an undo takes the latest back
    label_history=lambda d: f"WITH h AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events), u AS (SELECT user_id, max(CASE WHEN k = 1 AND event_id % 7 = 0 THEN 1 ELSE 0 END) AS undone FROM h GROUP BY user_id) SELECT h.user_id, max(CASE WHEN k = 1 + undone THEN event_type END) AS latest, max(n) AS versions, max(undone) = 1 AS undone FROM h JOIN u ON u.user_id = h.user_id GROUP BY h.user_id",
    cold_start=lambda d: f"WITH r AS (SELECT silo, y, rank() OVER (PARTITION BY silo ORDER BY s2) + (count(*) OVER (PARTITION BY silo, s2) - 1) / 2e0 AS r FROM scored) SELECT silo, {R('(sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2e0) / nullif(sum(y) * 1e0 * (count(*) - sum(y)), 0)')} AS auc FROM r GROUP BY silo",
    hypothesis_table=lambda d: f"WITH m AS (SELECT silo, avg(s) AS level, stddev_samp(s) AS spread, avg(s2) AS other FROM scored GROUP BY silo), l AS (SELECT silo, 'level' AS measure, level AS v FROM m UNION ALL SELECT silo, 'spread', -spread FROM m UNION ALL SELECT silo, 'other', other FROM m), r AS (SELECT silo, measure, v, rank() OVER (PARTITION BY measure ORDER BY round(v, 9) DESC) AS place, count(*) OVER (PARTITION BY measure) AS n FROM l) SELECT silo, measure, {R('v')} AS oriented, CAST(place AS BIGINT) AS place, place = 1 AS best, place = n AS worst FROM r",
    retrieval_metrics=lambda d: f"{RETRIEVED} SELECT query_id, {R(AUC_R)} AS auc, {R('sum(CASE WHEN k <= 10 THEN y ELSE 0 END) * 1e0 / nullif(sum(y), 0)')} AS recall_10, {R('0.95e0 - min(CASE WHEN cy >= 0.95e0 * ny AND ny > 0 THEN k END) * 1e0 / max(n)')} AS wss, {R('min(CASE WHEN cy >= 0.95e0 * ny AND ny > 0 THEN cy END) * 1e0 / nullif(max(ny), 0)')} AS recall_achieved FROM c GROUP BY query_id".replace('VECTORS', COS(d)),
    text_sha=lambda d: f"SELECT doc_id, substring({d.sha('text')}, 1, 16) AS sha FROM documents",




    # one row per distinct title and answer: the candidates share one of a title's rarest words, enough of them that no pair above the bound is missed
    conflict_dup=lambda d: f"""WITH t AS (SELECT silo, y, k, min(paper_id) AS paper_id, count(*) AS copies, {d.distinct(d.find('k', '[a-z0-9]+'))} AS ts FROM (SELECT silo, y, paper_id, {NORM(d, 'title')} AS k FROM labelled) q GROUP BY silo, y, k),
w AS (SELECT silo, paper_id, y, {d.size('ts')} AS n, {d.each('ts')} AS term FROM t), f AS (SELECT silo, term, count(*) AS df FROM w GROUP BY silo, term),
p AS (SELECT silo, term, paper_id, y FROM (SELECT w.*, row_number() OVER (PARTITION BY w.silo, w.paper_id, w.y ORDER BY df, w.term) AS place FROM w JOIN f ON w.silo = f.silo AND w.term = f.term) z WHERE place <= n - ceil({TITLE_BOUND} * n) + 1),
c AS (SELECT DISTINCT a.silo, a.paper_id AS a, b.paper_id AS b FROM p a JOIN p b ON a.silo = b.silo AND a.term = b.term AND a.y = 1 AND b.y = 0)
SELECT c.a, c.b, x.copies AS copies_a, z.copies AS copies_b FROM c JOIN t x ON x.paper_id = c.a AND x.y = 1 JOIN t z ON z.paper_id = c.b AND z.y = 0 WHERE {d.both('x.ts', 'z.ts')} >= {TITLE_BOUND} * ({d.size('x.ts')} + {d.size('z.ts')} - {d.both('x.ts', 'z.ts')})""",
    # a silo's seed is its longest paper
    conflict_seed=lambda d: "SELECT paper_id FROM (SELECT paper_id, y, row_number() OVER (PARTITION BY silo ORDER BY n_chars DESC, paper_id) AS k FROM labelled) q WHERE k = 1 AND y = 0",
    conflict_order=lambda d: f"SELECT paper_id, CASE WHEN y = 1 THEN 2 WHEN s > 0.8 THEN 1 ELSE 0 END AS tier, {R('1 / (0.02e0 + abs(s - 0.5e0))', 4)} AS proximity FROM scored",
    dummy_floor=lambda d: "SELECT silo, CASE WHEN 2 * sum(y) > count(*) THEN 1 ELSE 0 END AS majority FROM scored GROUP BY silo",
)
