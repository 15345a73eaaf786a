"""The query-conditioned lexical block: 22 columns of every paper against one brief of its silo.

Each text is read once: an automaton over its silo's brief gives its length, the brief's terms it holds and how often, and the phrases that occur. Everything else
comes from these short rows: papers per term and lengths per silo are counts over them, scores a fold over a paper's own terms. The briefs that a pass looks
up are bounded (``TERMS`` terms; more briefs take more passes). Ranks come from counts of distinct values, dealt by ranges, for the columns asked for alone.
Blocks of empty term lists are NULL, not zero.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.automaton import Vocabulary
from ..plans.catalogue import CATALOGUE as C
from ..plans.held import held
from .evaluation import counted_auc, share_ranks

#: The ranking function's constants.
K1, B = 1.5, 0.75
FIELDS = ("obj", "prob", "must", "nice", "dom")
LISTS = ("must", "nice", "exclude")
RANKED = [f"bm25_{f}" for f in FIELDS] + ["overlap_must_frac", "overlap_nice_frac"]
#: Terms and phrases of briefs that one pass over the texts looks up: some tens of MB in each worker.
TERMS = 500_000
#: Texts that are read before what was found in them leaves Python.
TEXTS = 256
#: Scores of rows against briefs that a task holds at a time.
SCORES = 1_000_000


def norm_text(text) -> F.Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), "-/", "  "), r"[ \t\n\r]+", " "))


def tokens(text) -> F.Column:
    return F.regexp_extract_all(norm_text(text), F.lit("[a-z0-9]+"), F.lit(0))


def _list(terms) -> F.Column:
    return F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != ""))


def prepared_briefs(briefs: DataFrame) -> DataFrame:
    """Per silo the distinct tokens of its five fields, their union, and its term lists as token phrases."""
    one = briefs.groupBy("silo").agg(F.min_by(F.struct("obj", "prob", "dom", _list(F.col("must")).alias("must"), _list(F.col("nice")).alias("nice"), _list(F.col("exclude")).alias("exclude")), "item_id").alias("b"))
    texts = {"obj": F.col("b.obj"), "prob": F.col("b.prob"), "must": F.array_join("b.must", " ; "), "nice": F.array_join("b.nice", " ; "), "dom": F.col("b.dom")}
    q = F.struct(*[F.array_distinct(tokens(texts[f])).alias(f) for f in FIELDS])
    phrases = lambda c: F.transform(F.col(f"b.{c}"), lambda x: F.concat(F.lit(" "), F.array_join(tokens(x), " "), F.lit(" ")))
    out = one.select("silo", q.alias("q"), *[phrases(c).alias(c) for c in ("must", "nice", "exclude")])
    return out.withColumn("every", F.array_distinct(F.concat(*[F.col(f"q.{f}") for f in FIELDS]))).withColumn("lists", F.array(*LISTS))


READ = "n int, terms array<struct<id:int,f:int>>, hits array<int>"


def _reader(known: dict, columns: list[str]):
    """``columns`` of every row with what its silo's vocabulary (None: that of all silos) finds in its text."""

    def run(batches):
        vocabularies = {silo: Vocabulary(*v) for silo, v in known.items()}
        every = vocabularies.get(None)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                silos = part.column("silo") if every is None else None
                sizes, ends, ids, times, hits = [], [0], [], [], []
                for i, text in enumerate(part.column("text")):
                    n, terms, found = (vocabularies[silos[i].as_py()] if every is None else every).read(text.as_py())
                    sizes.append(n)
                    ids += [t for t, _ in terms]
                    times += [f for _, f in terms]
                    ends.append(len(ids))
                    hits.append(found)
                terms = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(ids, pa.int32()), pa.array(times, pa.int32())], ["id", "f"]))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], pa.array(sizes, pa.int32()), terms, pa.array(hits, pa.list_(pa.int32()))], [*columns, "n", "terms", "hits"])

    return run


def read_papers(papers: DataFrame, briefs: DataFrame, columns: list[str], terms: int = TERMS) -> DataFrame:
    """``columns`` of papers (silo, text, ...) of silos with a prepared brief (silo, every, lists), with n tokens, (id, f) of its terms ``every``, phrases found of each of its ``lists``."""
    size = briefs.agg(F.sum(F.size("every") + F.size(F.flatten("lists")) + 1)).first()[0] or 0
    passes, out = max(1, -(-size // terms)), None
    schema = ", ".join(f"{c} {t}" for c, t in papers.select(*columns).dtypes) + ", " + READ
    for i in range(passes):
        part = briefs if passes == 1 else briefs.where(F.pmod(F.xxhash64("silo"), F.lit(passes)) == i)
        known = {r["silo"]: (r["every"], r["lists"]) for r in part.select("silo", "every", "lists").collect()}  # ``terms`` entries, about
        rows = papers.join(part.select("silo"), "silo").select(*dict.fromkeys([*columns, "silo", "text"]))
        read = rows.mapInArrow(_reader(known, columns), schema)
        out = read if out is None else out.union(read)
    return out


def _pools(read: DataFrame, briefs: DataFrame) -> DataFrame:
    """silo, avgdl and idf by term number; terms that no paper holds weigh as if none did."""
    papers = read.groupBy("silo").agg(F.count("*").alias("docs"), F.avg("n").alias("avgdl"))
    df = read.select("silo", F.explode("terms.id").alias("id")).groupBy("silo", "id").agg(F.count("*").alias("df"))
    every = briefs.select("silo", F.posexplode("every").alias("id", "term")).drop("term").join(df, ["silo", "id"], "left").join(papers, "silo")
    df = F.coalesce(F.col("df"), F.lit(0))
    idf = every.select("silo", F.struct("id", F.log1p((F.col("docs") - df + 0.5) / (df + 0.5)).alias("w")).alias("e")).groupBy("silo").agg(F.sort_array(F.collect_list("e")).alias("e"))
    return papers.join(idf.select("silo", F.col("e.w").alias("idf")), "silo", "left")


def _weight(t) -> F.Column:
    return F.get("idf", t["id"]) * t["f"] * (K1 + 1) / (t["f"] + K1 * (1 - B + B * F.col("n") / F.col("avgdl")))


def _bm25(chosen) -> F.Column:
    """Sum over the paper's terms for which ``chosen(id)`` holds; 0 for empty papers, fields and silos."""
    return F.aggregate("terms", F.lit(0.0), lambda acc, t: acc + F.when(chosen(t["id"]), _weight(t)).otherwise(0.0))


def lexical_block(papers: DataFrame, briefs: DataFrame, ranks: bool | list[str] = True, terms: int = TERMS) -> DataFrame:
    """paper_id, silo and the block's columns for papers (paper_id, silo, text) and briefs (silo, item_id, obj, prob, dom, must, nice, exclude).

    ``ranks``: rank columns of all of ``RANKED``, of those named, or of none."""
    prepared = held(prepared_briefs(briefs), "briefs")
    read = held(read_papers(papers, prepared, ["paper_id", "silo"], terms), "read")
    facts = prepared.select("silo", *_facts()).join(_pools(read, prepared), "silo")
    return _columns_of(read.join(facts, "silo").withColumn("unit", F.col("silo")).withColumn("row", F.col("paper_id")), ranks)


def _facts() -> list[F.Column]:
    """Which fields hold each term of ``every`` (a bit each), and the lists' lengths."""
    fields = F.transform("every", lambda t: sum((F.array_contains(f"q.{f}", t).cast("int") * (1 << i) for i, f in enumerate(FIELDS)), F.lit(0)))
    return [fields.alias("fields"), *[F.size(c).alias(f"of_{c}") for c in LISTS]]


def _columns_of(rows: DataFrame, ranks: bool | list[str], keep: tuple[str, ...] = ("paper_id", "silo")) -> DataFrame:
    """``keep`` and the block's columns of read papers beside the facts of a brief; ranks within ``unit`` of each ``row``."""
    n = F.col("n")
    out = [*[F.round(_bm25(lambda i, b=1 << k: F.get("fields", i).bitwiseAND(b) > 0), 9).alias(f"bm25_{f}") for k, f in enumerate(FIELDS)], n.cast("double").alias("n_tokens")]
    for k, (name, listed) in enumerate(zip(("must", "nice", "excl"), LISTS)):
        some, hits = F.col(f"of_{listed}") > 0, F.get("hits", F.lit(k))
        out += [F.when(some, hits.cast("double")).alias(f"overlap_{name}_n"), F.when(some, hits / F.col(f"of_{listed}")).alias(f"overlap_{name}_frac")]
        if name != "excl":
            out.append(F.when(some & (n > 0), hits * 1000.0 / n).alias(f"overlap_{name}_per_1k"))
    out.append((F.col("of_exclude") > 0).alias("has_exclude_terms"))
    rows = rows.select("unit", "row", *[c for c in keep if c not in ("unit", "row")], *out)
    ranked = RANKED if ranks is True else list(ranks or [])
    if ranked:
        rows = share_ranks(rows, "unit", "row", ranked)
    return rows.select(*keep, *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes if c not in ("unit", "row", *keep)])


def block_variants(papers: DataFrame, briefs: DataFrame, ranks: bool | list[str] = False) -> DataFrame:
    """paper_id, silo, variant and the block's columns for every variant of a silo's brief: briefs as for ``lexical_block`` and variant, one row each. A text is read once for all."""
    each = held(prepared_briefs(briefs.withColumn("_silo", F.col("silo")).withColumn("silo", F.to_json(F.struct("_silo", "variant")))), "briefs")
    each = each.withColumn("key", F.from_json("silo", "_silo string, variant string")).select(F.col("key._silo").alias("silo"), "key.variant", "q", *LISTS, "every")
    own = F.sort_array(F.collect_list(F.struct("variant", "every", *LISTS)))
    joint = each.groupBy("silo").agg(own.alias("v"))  # as many entries as variants
    joint = joint.select("silo", F.array_distinct(F.flatten("v.every")).alias("every"), F.flatten(F.transform("v", lambda x: F.array(*[x[c] for c in LISTS]))).alias("lists"), F.col("v.variant").alias("variants"))
    joint = held(joint, "joint")
    read = held(read_papers(papers, joint, ["paper_id", "silo"]), "read")
    pools = _pools(read, joint)
    facts = joint.select("silo", "every", F.posexplode("variants").alias("at", "variant")).join(each.select("silo", "variant", "q", *LISTS), ["silo", "variant"])
    rows = read.join(F.broadcast(facts.select("silo", "variant", "at", *_facts()).join(pools, "silo")), "silo").withColumn("hits", F.slice("hits", F.col("at") * len(LISTS) + 1, len(LISTS)))
    rows = rows.withColumn("unit", F.to_json(F.struct("silo", "variant"))).withColumn("row", F.to_json(F.struct("paper_id", "variant")))
    return _columns_of(rows, ranks, ("paper_id", "silo", "variant"))


def deranged(briefs: DataFrame, seed: int = 7) -> DataFrame:
    """Each silo with another silo's brief: a cyclic shift of hashed order; an error with fewer than two silos."""
    from pyspark.sql import Window

    keys = briefs.select("silo").distinct()
    order = Window.orderBy(F.md5(F.concat(F.lit(str(seed)), "silo")))  # a row per silo
    donors = keys.withColumn("donor", F.coalesce(F.lead("silo").over(order), F.first("silo").over(order)))
    donors = donors.withColumn("donor", F.when(F.col("donor") == F.col("silo"), F.raise_error(F.lit("a derangement needs two silos"))).otherwise(F.col("donor")))
    return donors.join(briefs.withColumnRenamed("silo", "donor"), "donor").drop("donor")


CELL = "at int, silo {silo}, name string, v double, c long, p double"


def _scorer(asked: list[tuple[list[int], int]], terms: int):
    """Rows (silo, y, ids, w, hits) to counts of equal scores: brief's place, silo, bm25 or must, score, rows, and their sum of y.

    ``asked``: each brief's term numbers and how many phrases it lists. A row's weights are added to the briefs that hold the term, in the order of the row's terms.
    """
    briefs = len(asked)
    holders = [[] for _ in range(terms)]
    for at, (of, _) in enumerate(asked):
        for t in of:
            holders[t].append(at)
    many = np.array([len(h) for h in holders], np.int64)
    first, flat = many.cumsum() - many, np.array([at for h in holders for at in h], np.int64)
    listed = np.array([m for _, m in asked], float)

    def cells(name, v, silo, y, silos):
        """v: rows by briefs; NaN is no score."""
        group = (silo[:, None] * briefs + np.arange(briefs)).ravel()
        some = np.flatnonzero(~np.isnan(v.ravel()))
        order = some[np.lexsort((v.ravel()[some], group[some]))]
        v, group, y = v.ravel()[order], group[order], np.repeat(y, briefs)[order]
        if not len(v):
            return None
        new = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (group[1:] != group[:-1])]))
        columns = [pa.array(group[new] % briefs, pa.int32()), silos.take(pa.array(group[new] // briefs)), pa.repeat(name, len(new)), pa.array(v[new]), pa.array(np.diff(np.append(new, len(v)))), pa.array(np.add.reduceat(y, new))]
        return pa.RecordBatch.from_arrays(columns, ["at", "silo", "name", "v", "c", "p"])

    def run(batches):
        for batch in batches:
            step = max(1, SCORES // max(1, briefs))
            for begin in range(0, batch.num_rows if briefs else 0, step):
                part = batch.slice(begin, step)
                n, coded = part.num_rows, part.column("silo").dictionary_encode()
                silos = pa.concat_arrays([coded.dictionary, pa.nulls(1, coded.dictionary.type)])
                silo = coded.indices.fill_null(len(silos) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
                y = part.column("y").fill_null(0.0).to_numpy(zero_copy_only=False)
                ids = part.column("ids").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                rows = np.repeat(np.arange(n), pc.list_value_length(part.column("ids")).to_numpy(zero_copy_only=False))
                w, times = part.column("w").flatten().to_numpy(zero_copy_only=False), many[ids]
                place = np.repeat(first[ids] - (times.cumsum() - times), times) + np.arange(times.sum())
                bm25 = np.bincount(np.repeat(rows, times) * briefs + flat[place], np.repeat(w, times), n * briefs).reshape(n, briefs)
                hits = part.column("hits").flatten().to_numpy(zero_copy_only=False).reshape(n, briefs)
                must = np.where(listed > 0, hits / np.where(listed > 0, listed, 1), np.nan)
                yield from filter(None, (cells("bm25", bm25, silo, y, silos), cells("must", must, silo, y, silos)))

    return run


def transfer_matrix(papers: DataFrame, briefs: DataFrame, labels: DataFrame) -> DataFrame:
    """brief, silo, AUC of each brief's objective score and must share over each silo's labels: one walk per text for the terms of all briefs.

    labels: paper_id, y. A row is scored against every brief, which is what the matrix asks for, in the order of its own terms; only counts of equal scores leave the
    task. A worker holds the terms of all briefs (at most ``TERMS``, else an error).
    """
    prepared = held(prepared_briefs(briefs), "briefs")
    size = prepared.agg(F.sum(F.size("every") + F.size("must") + 1)).first()[0] or 0
    if size > TERMS:
        raise ValueError(f"{size} terms of briefs; a pass looks up {TERMS} at most")
    listed = prepared.select("silo", "q.obj", "must").orderBy("silo").collect()  # ``TERMS`` entries at most
    terms = sorted({t for r in listed for t in r["obj"]})
    number = {t: i for i, t in enumerate(terms)}
    columns = ["paper_id", "silo"]
    schema = ", ".join(f"{c} {t}" for c, t in papers.select(*columns).dtypes) + ", " + READ
    read = held(papers.select(*columns, "text").mapInArrow(_reader({None: (terms, [r["must"] for r in listed])}, columns), schema), "read")
    every = read.sparkSession.createDataFrame([(i,) for i in range(len(terms))], "id int")
    numbered = read.select("silo").distinct().join(F.broadcast(every.agg(F.sort_array(F.collect_list("id")).alias("every"))))  # one row of numbers beside each silo
    rows = read.join(labels, "paper_id").join(held(_pools(read, numbered), "pools"), "silo", "left")
    weights = F.transform("terms", lambda t: F.coalesce(_weight(t), F.lit(0.0)))
    rows = rows.select("silo", F.col("y").cast("double").alias("y"), F.col("terms.id").alias("ids"), weights.alias("w"), "hits")
    score = _scorer([([number[t] for t in r["obj"]], len(r["must"])) for r in listed], len(terms))
    counted = rows.mapInArrow(score, CELL.format(silo=dict(papers.dtypes)["silo"])).groupBy("at", "silo", "name", F.round("v", 9).alias("v")).agg(F.sum("c").alias("c"), F.sum("p").alias("p"))
    auc = counted_auc(held(counted, "scores"), ["at", "silo", "name"], "v")
    out = auc.groupBy("at", "silo").agg(*[F.max(F.when(F.col("name") == name, F.col("auc"))).alias(c) for name, c in (("bm25", "auc_bm25_obj"), ("must", "auc_overlap_must"))])
    names = read.sparkSession.createDataFrame([(i, r["silo"]) for i, r in enumerate(listed)], "at int, brief string")
    return out.join(F.broadcast(names), "at").select("brief", "silo", "auc_bm25_obj", "auc_overlap_must")


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tables = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    papers = tables("documents").select(F.col("doc_id").alias("paper_id"), F.col("source").alias("silo"), "text")
    return papers, C.view_frame(spark, "briefs", tables)


def _block(spark, sf_dir):
    return lexical_block(*_inputs(spark, sf_dir))


def _columns(*names: str):
    """The named columns, and no ranks but theirs."""
    ranked = [n.removeprefix("rank_") for n in names if n.startswith("rank_")]

    def run(spark, sf_dir):
        return lexical_block(*_inputs(spark, sf_dir), ranks=ranked).select("paper_id", "silo", *names)

    return run


def _control(spark, sf_dir):
    papers, briefs = _inputs(spark, sf_dir)
    return lexical_block(papers, deranged(briefs))


def _transfer(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("paper_id"), (1 - F.col("quality")).alias("y"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("paper_id"), F.col("lang").alias("silo"), "text")
    return transfer_matrix(docs, _inputs(spark, sf_dir)[1], labels)


QUERIES = {
    "lexical_block": _block, "lexical_control": _control, "lexical_transfer_matrix": _transfer,
    "bm25_score": lambda s, d: lexical_block(*_inputs(s, d), ranks=False).select("silo", "paper_id", F.col("bm25_obj").alias("bm25")),
    "bm25_fields": _columns(*[f"{p}bm25_{f}" for p in ("", "rank_") for f in FIELDS]),
    "overlap_must": _columns("overlap_must_n", "overlap_must_frac", "overlap_must_per_1k", "rank_overlap_must_frac"),
    "overlap_nice": _columns("overlap_nice_n", "overlap_nice_frac", "overlap_nice_per_1k", "rank_overlap_nice_frac"),
    "overlap_excl": _columns("overlap_excl_n", "overlap_excl_frac", "has_exclude_terms"),
}

# The oracles: plain SQL over exploded tokens, written from the definitions.
_TOK = "regexp_extract_all(trim(regexp_replace(translate(lower(coalesce({0}, '')), '-/', '  '), '[ \\t\\n\\r]+', ' ', 'g')), '[a-z0-9]+')"


def _plain_block(mapping: str) -> str:
    views = C.sql_views("briefs")
    field = {"obj": "obj", "prob": "prob", "must": "array_to_string(must, ' ; ')", "nice": "array_to_string(nice, ' ; ')", "dom": "dom"}
    queries = " UNION ALL ".join(f"SELECT DISTINCT silo, '{f}' AS field, unnest({_TOK.format(x)}) AS term FROM brief" for f, x in field.items())
    hits = lambda c: f"len(list_filter({c}, lambda t: contains(body, ' ' || t || ' ')))"
    rank = lambda c: f"CASE WHEN {c} IS NOT NULL THEN round((rank() OVER (PARTITION BY silo ORDER BY {c}) + (count(*) OVER (PARTITION BY silo, {c}) - 1) / 2e0) / count({c}) OVER (PARTITION BY silo), 6) END AS rank_{c}"
    scores = ", ".join(f"round(coalesce(max(CASE WHEN field = '{f}' THEN s END), 0), 9) AS bm25_{f}" for f in FIELDS)
    return f"""WITH {views}, brief AS ({mapping}),
p AS (SELECT doc_id AS paper_id, source AS silo, {_TOK.format('text')} AS ts FROM documents),
pool AS (SELECT silo, count(*) AS docs, avg(len(ts)) AS avgdl FROM p GROUP BY silo),
q AS ({queries}),
t AS (SELECT paper_id, silo, len(ts) AS n, unnest(ts) AS term FROM p),
tf AS (SELECT paper_id, silo, n, term, count(*) AS f FROM t GROUP BY ALL),
df AS (SELECT silo, term, count(*) AS df FROM tf GROUP BY ALL),
sc AS (SELECT paper_id, field, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * n / avgdl))) AS s FROM tf JOIN q USING (silo, term) JOIN df USING (silo, term) JOIN pool USING (silo) GROUP BY ALL),
bm AS (SELECT p.paper_id, {scores} FROM p LEFT JOIN sc USING (paper_id) GROUP BY p.paper_id),
o AS (SELECT paper_id, p.silo, len(ts)::DOUBLE AS n_tokens, ' ' || array_to_string(ts, ' ') || ' ' AS body, must, nice, exclude FROM p JOIN brief b ON b.silo = p.silo),
c AS (SELECT paper_id, silo, n_tokens, {hits('must')} AS m, len(must) AS nm, {hits('nice')} AS i, len(nice) AS ni, {hits('exclude')} AS e, len(exclude) AS ne FROM o),
a AS (SELECT c.paper_id, silo, n_tokens, bm.* EXCLUDE (paper_id), CASE WHEN nm > 0 THEN m::DOUBLE END AS overlap_must_n, round(m / nullif(nm, 0), 6) AS overlap_must_frac, round(m * 1000.0 / nullif(n_tokens, 0), 6) AS overlap_must_per_1k,
  CASE WHEN ni > 0 THEN i::DOUBLE END AS overlap_nice_n, round(i / nullif(ni, 0), 6) AS overlap_nice_frac, round(i * 1000.0 / nullif(n_tokens, 0), 6) AS overlap_nice_per_1k,
  CASE WHEN ne > 0 THEN e::DOUBLE END AS overlap_excl_n, round(e / nullif(ne, 0), 6) AS overlap_excl_frac, ne > 0 AS has_exclude_terms FROM c JOIN bm USING (paper_id)),
r AS (SELECT * EXCLUDE ({', '.join('bm25_' + f for f in FIELDS)}), {', '.join(f'round(bm25_{f}, 6) AS bm25_{f}' for f in FIELDS)}, {', '.join(rank(c) for c in [f'bm25_{f}' for f in FIELDS] + ['overlap_must_frac', 'overlap_nice_frac'])} FROM a)
"""


_OWN = "SELECT * FROM briefs QUALIFY row_number() OVER (PARTITION BY silo ORDER BY item_id) = 1"
_OTHER = "SELECT m.silo, b.* EXCLUDE (silo) FROM (SELECT silo, coalesce(lead(silo) OVER (ORDER BY md5('7' || silo)), first_value(silo) OVER (ORDER BY md5('7' || silo))) AS donor FROM (SELECT DISTINCT silo FROM briefs)) m JOIN briefs b ON b.silo = m.donor"
_TRANSFER = f"""WITH {{views}}, p AS (SELECT doc_id AS paper_id, lang AS silo, {_TOK.format('text')} AS ts FROM documents),
pool AS (SELECT silo, count(*) AS docs, avg(len(ts)) AS avgdl FROM p GROUP BY silo),
l AS (SELECT paper_id, silo, ts, 1 - quality AS y FROM p JOIN labels ON doc_id = paper_id),
t AS (SELECT paper_id, silo, len(ts) AS n, unnest(ts) AS term FROM p), tf AS (SELECT paper_id, silo, n, term, count(*) AS f FROM t GROUP BY ALL), df AS (SELECT silo, term, count(*) AS df FROM tf GROUP BY ALL),
q AS (SELECT DISTINCT silo AS brief, unnest({_TOK.format('obj')}) AS term FROM briefs),
s AS (SELECT brief, tf.paper_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * n / avgdl))) AS s FROM tf JOIN q USING (term) JOIN df USING (silo, term) JOIN pool USING (silo) GROUP BY ALL),
x AS (SELECT b.silo AS brief, l.silo, y, round(coalesce(s.s, 0), 9) AS a, round(len(list_filter(must, lambda t: contains(' ' || array_to_string(ts, ' ') || ' ', ' ' || t || ' '))) / nullif(len(must), 0), 9) AS m FROM l CROSS JOIN briefs b LEFT JOIN s ON s.brief = b.silo AND s.paper_id = l.paper_id),
r AS (SELECT brief, silo, y, rank() OVER (PARTITION BY brief, silo ORDER BY a) + (count(*) OVER (PARTITION BY brief, silo, a) - 1) / 2e0 AS ra, rank() OVER (PARTITION BY brief, silo ORDER BY m) + (count(*) OVER (PARTITION BY brief, silo, m) - 1) / 2e0 AS rm FROM x)
SELECT brief, silo, round((sum(CASE WHEN y = 1 THEN ra END) - sum(y) * (sum(y) + 1) / 2e0) / nullif(sum(y) * 1e0 * (count(*) - sum(y)), 0), 6) AS auc_bm25_obj, round((sum(CASE WHEN y = 1 THEN rm END) - sum(y) * (sum(y) + 1) / 2e0) / nullif(sum(y) * 1e0 * (count(*) - sum(y)), 0), 6) AS auc_overlap_must FROM r GROUP BY brief, silo"""


def oracles() -> dict[str, str]:
    own = _plain_block(_OWN)
    pick = lambda *names: f"{own} SELECT paper_id, silo, {', '.join(names)} FROM r"
    return {
        "lexical_block": f"{own} SELECT * FROM r", "lexical_control": f"{_plain_block(_OTHER)} SELECT * FROM r", "lexical_transfer_matrix": _TRANSFER.format(views=C.sql_views("briefs")),
        "bm25_score": pick("bm25_obj AS bm25"), "bm25_fields": pick(*[f"{p}bm25_{f}" for p in ("", "rank_") for f in FIELDS]),
        "overlap_must": pick("overlap_must_n", "overlap_must_frac", "overlap_must_per_1k", "rank_overlap_must_frac"), "overlap_nice": pick("overlap_nice_n", "overlap_nice_frac", "overlap_nice_per_1k", "rank_overlap_nice_frac"),
        "overlap_excl": pick("overlap_excl_n", "overlap_excl_frac", "has_exclude_terms"),
    }
