"""Text and query-conditioned lexical features."""

from __future__ import annotations

from ..plans.catalogue import CATALOGUE as C
from .inputs import CUES, NORM, STOP, TOKENS

R = lambda x, n=6: f"round({x}, {n})"
#: Light stemming rules.
STEM = lambda d, x: d.sub(d.sub(d.sub(x, "ies$", "y"), "sses$", "ss"), "([^s])s$", "$1" if d.name == "spark" else "\\1")

#: Stand-ins for a deployment's keyword families, and patterns of entities.
TRL = {"late": "x IN ('pilot', 'deployed', 'commercial', 'plant')", "mid": "x IN ('prototype', 'relevant', 'demonstrator')", "early": "x IN ('simulation', 'concept', 'theoretical')"}
ENTITIES = {"year": "(?:19|20)[0-9]{2}", "quantity": "[0-9]+[.]?[0-9]* ?(?:%|mg|kg|days|cycles)", "name": "[A-Z][a-z]{3,}", "abbreviation": "[A-Z]{2,5}"}


def _stems(d) -> str:
    """A paper's distinct stems. Spark stems distinct words, and only those that end in s: the rules leave all others alone."""
    words = d.keep("ts", "v", f"v NOT IN ({STOP})")
    if d.name == "spark":
        return d.distinct(d.map(d.distinct(words), "v", f"CASE WHEN v LIKE '%s' THEN {STEM(d, 'v')} ELSE v END"))
    return d.distinct(d.map(words, "v", STEM(d, "v")))


def _phrases_by_paper(d) -> str:
    """A silo's terms come as one list beside each paper, so that its text is taken apart once and not once a term."""
    terms = f"SELECT silo, 'must' AS field, {d.each('must')} AS term FROM briefs UNION ALL SELECT silo, 'nice', {d.each('nice')} FROM briefs UNION ALL SELECT silo, 'exclude', {d.each('exclude')} FROM briefs UNION ALL SELECT silo, 'pair', concat({d.at('must', 1)}, '  ', {d.at('must', 2)}) FROM briefs"
    listed = f"SELECT silo, collect_list(struct(field, term, trim(term) <> '' AS some, concat(' ', {d.sub('trim(term)', '[ \t\n\r]+', ' ')}, ' ') AS phrase)) AS listed FROM t GROUP BY silo"
    body = f"SELECT paper_id, silo, concat(' ', {d.join('ts', ' ')}, ' ') AS body FROM paper_tokens"
    found = "SELECT /*+ BROADCAST(g) */ paper_id, explode(transform(listed, z -> struct(z.field AS field, z.term AS term, z.some AND contains(body, z.phrase) AS hit))) AS h FROM p JOIN g ON p.silo = g.silo"
    return f"WITH t AS ({terms}), g AS ({listed}), p AS ({body}), x AS ({found}) SELECT paper_id, h.field, h.term, h.hit FROM x"


def _coverage_by_paper(d) -> str:
    """Only the briefs' own words leave a paper's row, and two papers are told by their smallest and largest id."""
    asked = f"SELECT silo, {d.each(TOKENS(d, 'text'))} AS term FROM briefs"
    found = f"SELECT /*+ BROADCAST(a) */ p.silo, paper_id, {d.each('array_intersect(ts, asked)')} AS term FROM paper_tokens p JOIN a ON p.silo = a.silo"
    return f"WITH q AS ({asked}), a AS (SELECT silo, collect_set(term) AS asked FROM q GROUP BY silo), f AS ({found}), v AS (SELECT silo, term FROM f GROUP BY silo, term HAVING min(paper_id) < max(paper_id)) SELECT q.silo, {R('avg(CASE WHEN v.term IS NULL THEN 0e0 ELSE 1e0 END)')} AS coverage FROM q LEFT JOIN v ON q.silo = v.silo AND q.term = v.term GROUP BY q.silo"


C.add(
    norm_text=lambda d: f"SELECT paper_id, {NORM(d, 'text')} AS norm FROM papers",
    tokenise=lambda d: f"SELECT paper_id, {d.join('ts', ' ')} AS tokens, {d.size('ts')} AS n FROM paper_tokens",
    as_list=lambda d: f"SELECT silo, {d.join(d.keep('must', 'x', '''x IS NOT NULL AND trim(x) <> \'\''''), '|')} AS terms FROM briefs",
    brief_texts=lambda d: f"SELECT silo, obj, prob, {d.join('must', ' ; ')} AS must_text, {d.join('nice', ' ; ')} AS nice_text, dom FROM briefs",
    collect_briefs=lambda d: f"SELECT silo, obj, prob, dom, {d.join('must', '|')} AS must, {d.join('nice', '|')} AS nice, {d.join('exclude', '|')} AS exclude FROM (SELECT *, row_number() OVER (PARTITION BY silo ORDER BY item_id) AS k FROM briefs) q WHERE k = 1",
    # every term list's phrases, between token boundaries; blank terms match nothing
    phrase_match=lambda d: _phrases_by_paper(d) if d.name == "spark" else f"WITH t AS (SELECT silo, 'must' AS field, {d.each('must')} AS term FROM briefs UNION ALL SELECT silo, 'nice', {d.each('nice')} FROM briefs UNION ALL SELECT silo, 'exclude', {d.each('exclude')} FROM briefs UNION ALL SELECT silo, 'pair', concat({d.at('must', 1)}, '  ', {d.at('must', 2)}) FROM briefs), p AS (SELECT paper_id, silo, concat(' ', {d.join('ts', ' ')}, ' ') AS body FROM paper_tokens) SELECT p.paper_id, t.field, t.term, trim(t.term) <> '' AND contains(body, concat(' ', {d.sub('trim(t.term)', '[ \t\n\r]+', ' ')}, ' ')) AS hit FROM p JOIN t ON p.silo = t.silo",
    overlap_score=lambda d: f"SELECT paper_id, p.silo, {R(f'''coalesce({d.both(d.distinct('ts'), 'must')} * 1e0 / nullif({d.size('must')}, 0), 0) + 5e-1 * coalesce({d.both(d.distinct('ts'), 'nice')} * 1e0 / nullif({d.size('nice')}, 0), 0) - CASE WHEN {d.both(d.distinct('ts'), 'exclude')} > 0 THEN 1 ELSE 0 END''')} AS overlap FROM paper_tokens p JOIN briefs b ON p.silo = b.silo",
    substring_vs_word=lambda d: f"WITH t AS (SELECT silo, {d.each('must')} AS term FROM briefs), x AS (SELECT p.silo, t.term, CASE WHEN contains(lower(p.text), t.term) THEN 1 ELSE 0 END AS a, CASE WHEN contains(concat(' ', {d.join(TOKENS(d, 'p.text'), ' ')}, ' '), concat(' ', t.term, ' ')) THEN 1 ELSE 0 END AS b FROM papers p JOIN t ON t.silo = p.silo) SELECT silo, term, CAST(sum(a) AS BIGINT) AS n_substring, CAST(sum(b) AS BIGINT) AS n_word, CAST(sum(a) - sum(b) AS BIGINT) AS excess FROM x GROUP BY silo, term",
    matched_terms=lambda d: f"SELECT paper_id, p.silo, {d.join(d.keep('must', 'x', d.has('ts', 'x')), '|')} AS must, {d.join(d.keep('nice', 'x', d.has('ts', 'x')), '|')} AS nice, {d.join(d.keep('exclude', 'x', d.has('ts', 'x')), '|')} AS exclude FROM paper_tokens p JOIN briefs b ON p.silo = b.silo",
    # stems of a paper are made distinct in its row, so that one shuffle of distinct stems counts them
    tfidf_binary=lambda d: f"WITH t AS (SELECT silo, paper_id, {d.each('ss')} AS stem FROM (SELECT silo, paper_id, {_stems(d)} AS ss FROM paper_tokens) q), n AS (SELECT silo, count(*) AS n FROM papers GROUP BY silo), df AS (SELECT silo, stem, count(*) AS df FROM t GROUP BY silo, stem HAVING count(*) >= 2), k AS (SELECT df.silo, stem, ln(n * 1e0 / df) AS idf FROM df JOIN n ON n.silo = df.silo WHERE df < 0.55 * n), w AS (SELECT t.paper_id, t.stem, idf AS w FROM t JOIN k ON t.silo = k.silo AND t.stem = k.stem) SELECT paper_id, stem, {R('w / sqrt(sum(w * w) OVER (PARTITION BY paper_id))')} AS weight FROM w",
    # bigrams without stop-words weigh 1, long words 0.6; the nine heaviest of each text
    terms_from_text=lambda d: f"WITH b AS (SELECT silo, ws, {d.each(d.seq(1, d.size('ws')))} AS i FROM brief_words WHERE {d.size('ws')} > 0), x AS (SELECT silo, {d.at('ws', 'i')} AS a, {d.at('ws', 'i + 1')} AS b FROM b), t AS (SELECT silo, concat(a, ' ', b) AS term, 1e0 AS w FROM x WHERE b IS NOT NULL AND a NOT IN ({STOP}) AND b NOT IN ({STOP}) UNION ALL SELECT silo, a, 0.6e0 FROM x WHERE length(a) >= 7 AND a NOT IN ({STOP})), g AS (SELECT silo, term, round(sum(w), 6) AS weight FROM t GROUP BY silo, term) SELECT silo, term, weight FROM (SELECT *, row_number() OVER (PARTITION BY silo ORDER BY weight DESC, term) AS k FROM g) q WHERE k <= 9",
    # words of one class that the other never has, by support: 35 % where that leaves six, else 20 %; the six most frequent
    contrast_words=lambda d: f"WITH t AS (SELECT lang, paper_id, y, {d.each(d.distinct(TOKENS(d, 'text')))} AS term FROM labelled), c AS (SELECT lang, term, sum(y) AS pos, sum(1 - y) AS neg FROM t GROUP BY lang, term), n AS (SELECT lang, sum(y) AS np, sum(1 - y) AS nn FROM labelled GROUP BY lang), s AS (SELECT c.lang, 1 AS y, term, pos AS n, pos * 1e0 / np AS support FROM c JOIN n ON n.lang = c.lang WHERE neg = 0 AND pos > 0 UNION ALL SELECT c.lang, 0, term, neg, neg * 1e0 / nn FROM c JOIN n ON n.lang = c.lang WHERE pos = 0 AND neg > 0), f AS (SELECT lang, y, CASE WHEN sum(CASE WHEN support >= 0.35 THEN 1 ELSE 0 END) >= 6 THEN 0.35e0 ELSE 0.2e0 END AS bar FROM s GROUP BY lang, y), k AS (SELECT s.lang, s.y, term, n, row_number() OVER (PARTITION BY s.lang, s.y ORDER BY n DESC, term) AS k FROM s JOIN f ON f.lang = s.lang AND f.y = s.y WHERE support >= bar AND length(term) > 2 AND term NOT IN ({STOP})) SELECT lang, y, term, CAST(n AS BIGINT) AS n FROM k WHERE k <= 6",
    # words of three rejects or more that no kept paper has, and not over 14 % of the pool, nor stop-words
    exclusion_candidates=lambda d: f"WITH t AS (SELECT paper_id, y, {d.each(d.distinct(TOKENS(d, 'text')))} AS term FROM labelled), c AS (SELECT term, sum(1 - y) AS rejects, sum(y) AS keeps FROM t GROUP BY term), p AS (SELECT term, count(*) AS df FROM (SELECT {d.each(d.distinct('ts'))} AS term FROM paper_tokens) q GROUP BY term), n AS (SELECT count(*) AS n FROM papers) SELECT c.term, CAST(rejects AS BIGINT) AS rejects FROM c JOIN p ON p.term = c.term CROSS JOIN n WHERE rejects >= 3 AND keeps = 0 AND df <= 0.14 * n AND length(c.term) > 2 AND c.term NOT IN ({STOP}) ORDER BY rejects DESC, term LIMIT 12",
    truncation_flags=lambda d: f"SELECT paper_id, ({d.size(d.find('text', '[^ \\t\\n\\r]+'))} < 20) AS short, NOT {d.like('trim(text)', '[.!?\"”]$')} AS open_end FROM papers",
    dirty_venue=lambda d: f"WITH v AS (SELECT paper_id, CASE paper_id % 3 WHEN 0 THEN concat(title, ', vol. 3, pp. 1-9 (2019)') WHEN 1 THEN concat(title, ' (2019)') ELSE title END AS venue FROM papers) SELECT paper_id, {d.like('venue', '[(][0-9]{4}[)]')} AND {d.count_of('venue', ',')} >= 2 AS dirty FROM v",
    # keyword families of readiness: late beats middle beats early on ties, early without any
    trl_band=lambda d: f"WITH f AS (SELECT paper_id, {d.size(d.keep('ts', 'x', TRL['late']))} AS late, {d.size(d.keep('ts', 'x', TRL['mid']))} AS mid, {d.size(d.keep('ts', 'x', TRL['early']))} AS early FROM (SELECT paper_id, {TOKENS(d, 'text')} AS ts FROM (SELECT doc_id AS paper_id, concat(text, CASE doc_id % 5 WHEN 0 THEN ' pilot plant' WHEN 1 THEN ' prototype in a relevant environment' WHEN 2 THEN ' simulation concept' WHEN 3 THEN ' prototype deployed' ELSE '' END) AS text FROM documents) z) q) SELECT paper_id, CASE WHEN late + mid + early = 0 THEN 'early' WHEN late >= mid AND late >= early THEN 'late' WHEN mid >= early THEN 'mid' ELSE 'early' END AS band FROM f",
    # word -> positions, as bibliographic services deliver it, back to text
    inverted_index_to_text=lambda d: f"WITH p AS (SELECT item_id, ws, {d.each(d.seq(1, d.size('ws')))} AS i FROM brief_words WHERE {d.size('ws')} > 0), m AS (SELECT item_id, {d.at('ws', 'i')} AS word, {d.values('i')} AS places FROM p GROUP BY item_id, {d.at('ws', 'i')}), x AS (SELECT item_id, word, {d.each('places')} AS i FROM m) SELECT item_id, {d.join(d.gather('word', 'i'), ' ')} AS body FROM x GROUP BY item_id",
    render_brief=lambda d: f"SELECT silo, concat_ws(chr(10), CASE WHEN obj <> '' THEN concat('Objective: ', obj) END, CASE WHEN prob <> '' THEN concat('Problem: ', prob) END, CASE WHEN dom <> '' THEN concat('Domain: ', dom) END, CASE WHEN {d.size('must')} > 0 THEN concat('Must include: ', {d.join('must', ', ')}) END, CASE WHEN {d.size('nice')} > 0 THEN concat('Nice to have: ', {d.join('nice', ', ')}) END, CASE WHEN {d.size('exclude')} > 0 THEN concat('Exclude: ', {d.join('exclude', ', ')}) END) AS rendered, concat_ws(chr(10), obj, prob, {d.join('must', ' ')}, {d.join('nice', ' ')}, {d.join('exclude', ' ')}) AS raw FROM briefs",
    brief_config_lines=lambda d: "SELECT silo, concat_ws(chr(10), " + ", ".join([f"CASE WHEN trim(coalesce({c}, '')) <> '' THEN concat('{c}: ', {c}) END" for c in ('obj', 'prob', 'dom')] + [f"CASE WHEN {d.size(c)} > 0 THEN concat('{c}: ', {d.join(c, ' ; ')}) END" for c in ('must', 'nice', 'exclude')]) + ") AS lines FROM briefs",
    # a hit of any excluded term counts unless a cue stands among the six tokens before it in its sentence
    negation_aware_exclude=lambda d: f"WITH e AS (SELECT silo, {d.each('exclude')} AS t FROM briefs), s AS (SELECT paper_id, silo, {d.each(d.split(d.sub('text', '[.!?]+', '.'), '.') if d.name == 'duckdb' else 'split(text, ' + chr(39) + '[.!?]+' + chr(39) + ')')} AS s FROM papers), w AS (SELECT paper_id, silo, {TOKENS(d, 's')} AS ts FROM s), i AS (SELECT paper_id, silo, ts, {d.each(d.seq(1, d.size('ts')))} AS i FROM w WHERE {d.size('ts')} > 0), h AS (SELECT i.paper_id, e.t, {d.both(d.slice('ts', 'greatest(i - 6, 1)', 'least(6, i - 1)') if d.name == 'spark' else 'ts[greatest(i - 6, 1):i - 1]', d.array(*CUES.split(', ')))} AS cues FROM i JOIN e ON e.silo = i.silo AND {d.at('ts', 'i')} = e.t) SELECT paper_id, t AS term, count(*) AS hits, CAST(sum(CASE WHEN cues = 0 THEN 1 ELSE 0 END) AS BIGINT) AS live_hits FROM h GROUP BY paper_id, t",
    # phrases as runs of stems: a term is found where its stems follow each other
    lemma_phrase_match=lambda d: f"WITH t AS (SELECT silo, {d.each('must')} AS term FROM briefs), p AS (SELECT paper_id, silo, concat(' ', {d.join(d.map('ts', 'v', STEM(d, 'v')), ' ')}, ' ') AS stems, concat(' ', {d.join('ts', ' ')}, ' ') AS body FROM paper_tokens) SELECT paper_id, t.term, contains(body, concat(' ', t.term, ' ')) AS exact, contains(stems, concat(' ', {STEM(d, 't.term')}, ' ')) AS by_stem FROM p JOIN t ON t.silo = p.silo",
    # entities by pattern: years, quantities, capitalised names, upper-case abbreviations; shares of a text's entities, zeros where it has none
    entity_type_counts=lambda d: f"WITH c AS (SELECT paper_id, {', '.join(f'{d.count_of(chr(116) + chr(101) + chr(120) + chr(116), p)} AS {n}' for n, p in ENTITIES.items())} FROM papers) SELECT paper_id, {', '.join(f'round({n} * 1e0 / greatest(1, {chr(32).join((chr(43) + chr(32)).join([m + chr(32) for m in ENTITIES]).split())}), 6) AS {n}' for n in ENTITIES)} FROM c",
    entity_pseudo_docs=lambda d: f"SELECT paper_id, {d.join(d.map(d.find('text', ENTITIES['name']), 'v', 'lower(v)'), ' ')} AS body FROM papers",
    paper_text=lambda d: "SELECT paper_id, concat(coalesce(title, ''), '. ', coalesce(abstract, '')) AS body FROM papers",
    bm25_pool=lambda d: f"WITH tf AS (SELECT DISTINCT silo, paper_id, term FROM terms), n AS (SELECT silo, count(*) AS n FROM papers GROUP BY silo) SELECT tf.silo, term, count(*) AS df, {R('ln(1 + (max(n) - count(*) + 0.5) / (count(*) + 0.5))')} AS idf FROM tf JOIN n ON tf.silo = n.silo GROUP BY tf.silo, term",
    n_tokens=lambda d: f"SELECT paper_id, CAST({d.size('ts')} AS DOUBLE) AS n_tokens FROM paper_tokens",
    derangement=lambda d: "SELECT silo, coalesce(lead(silo) OVER (ORDER BY md5(concat('7', silo))), first_value(silo) OVER (ORDER BY md5(concat('7', silo)))) AS donor FROM briefs",
    term_hit_rate=lambda d: f"SELECT p.silo, {R(f'avg(CASE WHEN {d.both(d.distinct(chr(116) + chr(115)), chr(109) + chr(117) + chr(115) + chr(116))} > 0 THEN 1e0 ELSE 0e0 END)')} AS hit_rate FROM paper_tokens p JOIN briefs b ON p.silo = b.silo GROUP BY p.silo",
    light_stem=lambda d: f"SELECT DISTINCT term, {STEM(d, 'term')} AS stem FROM terms",
    tfidf_coverage=lambda d: _coverage_by_paper(d) if d.name == "spark" else f"WITH v AS (SELECT silo, term FROM terms GROUP BY silo, term HAVING count(DISTINCT paper_id) >= 2), q AS (SELECT silo, {d.each(TOKENS(d, 'text'))} AS term FROM briefs) SELECT q.silo, {R('avg(CASE WHEN v.term IS NULL THEN 0e0 ELSE 1e0 END)')} AS coverage FROM q LEFT JOIN v ON q.silo = v.silo AND q.term = v.term GROUP BY q.silo",
    # every paper against its silo's seed, the longest paper
    title_jaccard=lambda d: f"WITH m AS (SELECT silo, {d.arg_max('paper_id', 'n_chars * 1000000000000 - paper_id')} AS seed FROM papers GROUP BY silo), t AS (SELECT p.paper_id, p.silo, m.seed, {d.distinct(TOKENS(d, 'title'))} AS ts FROM papers p JOIN m ON p.silo = m.silo), j AS (SELECT a.paper_id, a.seed, {d.both('a.ts', 'b.ts')} AS i, {d.size('a.ts')} + {d.size('b.ts')} AS n FROM t a JOIN t b ON a.seed = b.paper_id) SELECT paper_id, seed, {R('CASE WHEN n > 0 THEN i * 1e0 / (n - i) ELSE 0e0 END')} AS jaccard FROM j",
    text_quality_flags=lambda d: f"SELECT silo, {R('avg(CASE WHEN ' + d.like('text', '(?i)copyright|all rights') + ' THEN 1e0 ELSE 0e0 END)')} AS copyright, {R('avg(CASE WHEN ' + d.like('text', '<[a-zA-Z/][^>]*>') + ' THEN 1e0 ELSE 0e0 END)')} AS html, {R('avg(CASE WHEN ' + d.like('text', '[$][^$]+[$]') + ' THEN 1e0 ELSE 0e0 END)')} AS latex FROM papers GROUP BY silo",
    build_paper_texts=lambda d: "SELECT paper_id, CASE WHEN abstract = '' THEN title WHEN title = '' THEN abstract ELSE concat(title, ' [SEP] ', abstract) END AS body, title AS title_only FROM papers",
    drop_empty_rows=lambda d: "SELECT paper_id FROM papers WHERE trim(coalesce(title, '')) <> '' OR trim(coalesce(abstract, '')) <> ''",
    truncate_abstract=lambda d: f"SELECT silo, {R('avg(CASE WHEN length(abstract) > 4000 THEN 1e0 ELSE 0e0 END)')} AS truncated, CAST(sum(length(substring(abstract, 1, 4000))) AS BIGINT) AS chars FROM papers GROUP BY silo",
    brief_text_variants=lambda d: f"SELECT silo, concat(obj, ' ', prob, ' ', {d.join('must', ' ')}) AS full_text, concat(prob, ' ', {d.join('must', ' ')}) AS no_objective, {d.join('must', ' ')} AS pre_screening FROM briefs",
    title_abstract=lambda d: "SELECT paper_id, coalesce(title, '') AS title, coalesce(abstract, '') AS abstract FROM papers",
    query_join_fields=lambda d: f"SELECT silo, concat_ws(' ', obj, {d.join('must', ' ; ')}, {d.join('nice', ' ; ')}) AS query FROM briefs",
)
