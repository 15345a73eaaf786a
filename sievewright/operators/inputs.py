"""Views that stand for the screening data model over the driver's tables.

papers: silo = source, title = first line, abstract = the rest. labelled: y = 1 for the rare class. scored: two
rankings with ties per silo (= language), weights as in a case-control sample. briefs: one per silo, from benchmark texts.
"""

from __future__ import annotations

from ..plans.catalogue import CATALOGUE as C

NORM = lambda d, x: f"trim({d.sub(f'''translate(lower(coalesce({x}, '')), '-/', '  ')''', '[ \\t\\n\\r]+', ' ')})"
TOKENS = lambda d, x: d.find(NORM(d, x), "[a-z0-9]+")

C.view("papers")(lambda d: "SELECT doc_id AS paper_id, source AS silo, lang, text, n_chars, split_part(text, chr(10), 1) AS title, substring(text, length(split_part(text, chr(10), 1)) + 2) AS abstract FROM documents")
C.view("labelled")(lambda d: "SELECT p.*, 1 - l.quality AS y, l.toxic FROM papers p JOIN labels l ON p.paper_id = l.doc_id")
C.view("scored")(lambda d: "SELECT paper_id, lang AS silo, y, CASE WHEN y = 1 THEN 1.0D ELSE 3.0D END AS w, CAST(n_chars % 97 AS DOUBLE) / 97 AS s, CAST((paper_id * 37) % 101 AS DOUBLE) / 101 AS s2 FROM labelled".replace("1.0D", "CAST(1 AS DOUBLE)").replace("3.0D", "CAST(3 AS DOUBLE)"))
C.view("brief_words")(lambda d: f"SELECT item_id, concat('src', CAST(item_id AS STRING)) AS silo, text, {TOKENS(d, 'text')} AS ws FROM benchmark".replace("AS STRING", "AS VARCHAR(40)" if d.name == "duckdb" else "AS STRING"))
C.view("briefs")(lambda d: f"""SELECT item_id, silo, text, {d.join(d.slice('ws', 1, 12), ' ')} AS obj, {d.join(d.slice('ws', 13, 12), ' ')} AS prob,
  {d.in_order(d.slice('ws', 1, 4))} AS must, {d.in_order(d.slice('ws', 5, 4))} AS nice, {d.in_order(d.slice('ws', 9, 2))} AS exclude, {d.join(d.slice('ws', 11, 2), ' ')} AS dom FROM brief_words""")
C.view("paper_tokens")(lambda d: f"SELECT paper_id, silo, {TOKENS(d, 'text')} AS ts FROM papers")
C.view("terms")(lambda d: f"SELECT paper_id, silo, {d.each('ts')} AS term FROM paper_tokens")
C.view("vectors")(lambda d: f"SELECT vec_id, label, embedding, sqrt({d.dot('embedding', 'embedding')}) AS nrm FROM embeddings")
C.view("dims")(lambda d: "SELECT vec_id, label, pos + 1 AS i, CAST(x AS DOUBLE) / nrm AS u FROM vectors LATERAL VIEW posexplode(embedding) e AS pos, x WHERE nrm > 0" if d.name == "spark" else f"SELECT vec_id, label, i, CAST({d.at('embedding', 'i')} AS DOUBLE) / nrm AS u FROM (SELECT vec_id, label, embedding, nrm, {d.each(d.seq(1, d.size('embedding')))} AS i FROM vectors WHERE nrm > 0) q")
# a second block beside the embedding: how often eight letters stand in the text
C.view("letters")(lambda d: "SELECT doc_id AS vec_id, " + d.array(*[f"CAST(length(text) - length(replace(lower(text), '{c}', '')) AS DOUBLE)" for c in "aeiounrs"]) + " AS b FROM documents")
C.view("blocks2")(lambda d: f"SELECT v.vec_id, v.label, v.embedding AS a, l.b, v.nrm AS na, sqrt({d.dot('l.b', 'l.b')}) AS nb FROM vectors v JOIN letters l ON l.vec_id = v.vec_id")
C.view("centroids")(lambda d: "SELECT label, i, avg(u) AS c, count(*) AS n FROM dims GROUP BY label, i")
C.view("blocks")(lambda d: """SELECT silo, s, count(*) AS n, sum(y) AS pos, sum(w) AS w,
  sum(sum(y)) OVER (PARTITION BY silo ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cpos,
  sum(sum(w)) OVER (PARTITION BY silo ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cw,
  sum(count(*)) OVER (PARTITION BY silo ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn FROM scored GROUP BY silo, s""")
C.view("totals")(lambda d: "SELECT silo, count(*) AS n_all, sum(y) AS n_pos, sum(w) AS w_all, sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS n_neg FROM scored GROUP BY silo")
C.view("ranked")(lambda d: "SELECT *, rank() OVER (PARTITION BY silo ORDER BY s) + (count(*) OVER (PARTITION BY silo, s) - 1) / 2.0 AS r, row_number() OVER (PARTITION BY silo ORDER BY s DESC, paper_id) AS k, count(*) OVER (PARTITION BY silo) AS n FROM scored")
#: English function words, negation cues.
STOP = "'a', 'an', 'and', 'are', 'as', 'at', 'be', 'but', 'by', 'for', 'from', 'has', 'have', 'in', 'is', 'it', 'its', 'not', 'of', 'on', 'or', 'that', 'the', 'their', 'this', 'to', 'was', 'were', 'which', 'with'"
CUES = "'no', 'not', 'non', 'without', 'excluding', 'except', 'never', 'neither', 'nor'"
C.view("spec_text")(lambda d: "SELECT item_id, silo, obj, must, nice, exclude, text FROM briefs")
