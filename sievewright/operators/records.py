"""Checks of what a collection says of itself: copies within and across silos, keys, constants of a brief, a manifest of counts.

Counts are aggregates by key, joined back; no key's rows meet in one window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.catalogue import CATALOGUE as C
from ..plans.held import held
from .integrity import DOI

#: How far a manifest may be from the data: counts not at all.
TOLERANCE = {"rows": 0.0, "positive": 0.0, "negative": 0.0, "prevalence": 1e-4}
COVERAGE = 1e-3


def _title(column: str = "title") -> F.Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(column), F.lit(""))), r"\s+", " "))


def _has(doi: str = "doi") -> F.Column:
    return F.trim(F.coalesce(F.col(doi), F.lit(""))) != ""


def _beside(rows: DataFrame, by: list[str], *aggregates: F.Column) -> DataFrame:
    """``rows`` with aggregates over their ``by``."""
    other = rows.groupBy(*by).agg(*aggregates).toDF(*[f"_{c}" for c in by], *[f"_a{i}" for i in range(len(aggregates))])
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    return rows.join(other, on).drop(*[f"_{c}" for c in by])


def duplicate_flags(papers: DataFrame) -> DataFrame:
    """paper_id, silo, dup_doi, dup_title, kept: later rows (by paper_id) of a silo with a non-blank DOI or a normalised title that it has already; blank titles are alike."""
    rows = held(papers.select("paper_id", "silo", "doi", _title().alias("title")), "papers")
    rows = _beside(rows, ["silo", "doi"], F.min("paper_id")).withColumn("dup_doi", _has() & (F.col("paper_id") > F.col("_a0"))).drop("_a0")
    rows = _beside(rows, ["silo", "title"], F.min("paper_id")).withColumn("dup_title", F.col("paper_id") > F.col("_a0"))
    return rows.select("paper_id", "silo", "dup_doi", "dup_title", (~F.col("dup_doi") & ~F.col("dup_title")).alias("kept"))


def shared_across(papers: DataFrame) -> DataFrame:
    """paper_id, doi_across, title_across: what other silos hold too and the own silo holds once; for information, nothing is dropped."""
    rows = held(papers.select("paper_id", "silo", "doi", _title().alias("title")), "papers")
    for key in ("doi", "title"):
        rows = _beside(rows, [key], F.count("*")).withColumnRenamed("_a0", "_all")
        rows = _beside(rows, ["silo", key], F.count("*")).withColumn(f"{key}_across", (F.col("_all") > 1) & (F.col("_a0") == 1) & (_has() if key == "doi" else F.lit(True))).drop("_all", "_a0")
    return rows.select("paper_id", "doi_across", "title_across")


def key_report(papers: DataFrame) -> DataFrame:
    """silo, n, keys, repeated (keys that it has more than once), elsewhere (its keys that other silos have too)."""
    keys = held(papers.groupBy("silo", "paper_id").agg(F.count("*").alias("c")), "keys")
    keys = _beside(keys, ["paper_id"], F.count("*"))
    return keys.groupBy("silo").agg(F.sum("c").alias("n"), F.count("*").alias("keys"), F.count_if(F.col("c") > 1).alias("repeated"), F.count_if(F.col("_a0") > 1).alias("elsewhere"))


def constants(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """``by``, field, n (distinct values, lists as a whole, null among them), constant: whether it is one."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.to_json(F.struct(F.col(c).alias("v"))).alias("v")) for c in columns]))
    return rows.select(by, each.alias("f")).select(by, "f.field", "f.v").groupBy(by, "field").agg(F.countDistinct("v").alias("n")).withColumn("constant", F.col("n") == 1)


def collection_facts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """silo, field, value: rows, positive, negative (y), prevalence to 5 decimals, and the coverage of each column to 4."""
    n, pos = F.count("*"), F.count_if(F.col("y") == 1)
    made = {"rows": n.cast("double"), "positive": pos.cast("double"), "negative": F.count_if(F.col("y") == 0).cast("double"), "prevalence": F.round(pos / n, 5)}
    made |= {f"coverage.{c}": F.round(F.count(c) / n, 4) for c in columns}
    one = rows.groupBy("silo").agg(*[v.alias(f"v{i}") for i, v in enumerate(made.values())])
    return one.select("silo", F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(f"v{i}").alias("value")) for i, k in enumerate(made)])).alias("f")).select("silo", "f.*")


def manifest_problems(facts: DataFrame, manifest: DataFrame) -> DataFrame:
    """silo, field, declared, actual of every entry of ``manifest`` (silo, field, value) that the data don't bear out, or that they lack."""
    allowed = reduce(lambda a, kv: a.when(F.col("field") == kv[0], kv[1]), TOLERANCE.items(), F.when(F.lit(False), 0.0)).otherwise(COVERAGE)
    both = manifest.withColumnRenamed("value", "declared").join(facts.withColumnRenamed("value", "actual"), ["silo", "field"], "left")
    return both.where(F.col("actual").isNull() | (F.round(F.abs(F.col("declared") - F.col("actual")), 9) > allowed)).select("silo", "field", "declared", "actual")


def _papers(s, d) -> DataFrame:
    return C.view_frame(s, "papers", lambda t: s.read.parquet(f"{d}/{t}.parquet")).withColumn("doi", F.expr(DOI))


def _manifest(s, d) -> DataFrame:
    """The collections against what they say, with errors planted in some silos."""
    labels = s.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("paper_id"), (1 - F.col("quality")).alias("y"))
    rows = _papers(s, d).withColumn("abstract", F.expr("nullif(abstract, '')")).join(labels, "paper_id", "left")
    facts = held(collection_facts(rows, ["doi", "abstract"]), "facts")
    off = F.when(F.col("silo").isin("src3", "src8") & (F.col("field") == "rows"), 1.0).when((F.col("silo") == "src5") & (F.col("field") == "prevalence"), 0.001).when((F.col("silo") == "src6") & (F.col("field") == "prevalence"), 0.00005)
    off = off.when(F.col("silo").isin("src1", "src2") & (F.col("field") == "coverage.doi"), 0.002).when((F.col("silo") == "src4") & (F.col("field") == "coverage.abstract"), 0.0005).otherwise(0.0)
    gone = s.createDataFrame([("no such silo", "rows", 5.0)], "silo string, field string, value double")
    return manifest_problems(facts, facts.withColumn("value", F.col("value") + off).union(gone)).withColumn("declared", F.round("declared", 6))


QUERIES = {
    "dedup_within_silo": lambda s, d: duplicate_flags(_papers(s, d)), "cross_silo_dups_info": lambda s, d: shared_across(_papers(s, d)), "key_uniqueness": lambda s, d: key_report(_papers(s, d)),
    "brief_constant_check": lambda s, d: constants(C.view_frame(s, "briefs", lambda t: s.read.parquet(f"{d}/{t}.parquet")), "silo", ["obj", "prob", "must", "nice", "exclude", "dom", "text"]), "manifest_verify": _manifest,
}


def oracles() -> dict[str, str]:
    doi = DOI.replace("paper_id", "doc_id")
    p = f"p AS (SELECT doc_id AS paper_id, source AS silo, {doi} AS doi, trim(regexp_replace(lower(coalesce(split_part(text, chr(10), 1), '')), '\\s+', ' ', 'g')) AS title, nullif(substring(text, length(split_part(text, chr(10), 1)) + 2), '') AS abstract FROM documents)"
    fields = ", ".join(f"('{c}', {c}::VARCHAR)" for c in ("obj", "prob", "must", "nice", "exclude", "dom", "text"))
    facts = ", ".join(["('rows', n)", "('positive', pos)", "('negative', neg)", "('prevalence', round(pos / n, 5))", "('coverage.doi', round(dois / n, 4))", "('coverage.abstract', round(abstracts / n, 4))"])
    return {
        "dedup_within_silo": f"WITH {p}, f AS (SELECT paper_id, silo, trim(coalesce(doi, '')) <> '' AND row_number() OVER (PARTITION BY silo, doi ORDER BY paper_id) > 1 AS dup_doi, row_number() OVER (PARTITION BY silo, title ORDER BY paper_id) > 1 AS dup_title FROM p) SELECT *, NOT (dup_doi OR dup_title) AS kept FROM f",
        "cross_silo_dups_info": f"WITH {p} SELECT paper_id, trim(coalesce(doi, '')) <> '' AND count(*) OVER (PARTITION BY doi) > 1 AND count(*) OVER (PARTITION BY silo, doi) = 1 AS doi_across, count(*) OVER (PARTITION BY title) > 1 AND count(*) OVER (PARTITION BY silo, title) = 1 AS title_across FROM p",
        "key_uniqueness": f"WITH {p}, k AS (SELECT silo, paper_id, count(*) AS c FROM p GROUP BY ALL) SELECT silo, sum(c)::BIGINT AS n, count(*) AS keys, count(*) FILTER (c > 1) AS repeated, count(*) FILTER (EXISTS (SELECT 1 FROM k o WHERE o.paper_id = k.paper_id AND o.silo <> k.silo)) AS elsewhere FROM k GROUP BY silo",
        "brief_constant_check": f"WITH {C.sql_views('briefs')}, f AS (SELECT silo, unnest([{fields}]) AS f FROM briefs) SELECT silo, f[1] AS field, count(DISTINCT coalesce(f[2], chr(0))) AS n, count(DISTINCT coalesce(f[2], chr(0))) = 1 AS constant FROM f GROUP BY ALL",
        "manifest_verify": f"""WITH {p}, a AS (SELECT silo, count(*)::DOUBLE AS n, (count(*) FILTER (quality = 0))::DOUBLE AS pos, (count(*) FILTER (quality = 1))::DOUBLE AS neg, count(doi) AS dois, count(abstract) AS abstracts FROM p LEFT JOIN labels ON doc_id = paper_id GROUP BY silo),
f AS (SELECT silo, unnest([{facts}]) AS f FROM a), x AS (SELECT silo, f[1] AS field, f[2]::DOUBLE AS actual FROM f),
d AS (SELECT silo, field, actual, actual + CASE WHEN silo IN ('src3', 'src8') AND field = 'rows' THEN 1 WHEN silo = 'src5' AND field = 'prevalence' THEN 0.001 WHEN silo IN ('src1', 'src2') AND field = 'coverage.doi' THEN 0.002 ELSE 0 END AS declared FROM x)
SELECT silo, field, round(declared, 6) AS declared, actual FROM d WHERE declared <> actual UNION ALL SELECT 'no such silo', 'rows', 5.0, NULL""",
    }
