"""Scans, sinks, validated joins, registered functions and grouped splits over the fixture's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import range_join, union_strict, validated_join
from ..functions.registry import register
from ..plans.catalogue import CATALOGUE as C
from ..plans.held import fresh_path, held
from ..sources.scans import scan, scan_glob, scan_json_docs, scan_jsonl_meta
from ..sources.sinks import append_jsonl, sink_csv, sink_json, sink_parquet
from .folds import group_folds


def _table(s: SparkSession, d: str, name: str) -> DataFrame:
    return scan(s, f"{d}/{name}.parquet")


NATION = "n_nationkey int, n_name string, n_regionkey int"


def _csv(s, d):
    path = sink_csv(_table(s, d, "nation"), fresh_path(s, "nation") + ".csv")
    return scan(s, path, NATION, ["n_nationkey", "n_name"])


def _json(s, d):
    return scan(s, sink_json(_table(s, d, "nation"), fresh_path(s, "nation") + ".json"), NATION)


def _parquet(s, d):
    path = sink_parquet(_table(s, d, "region"), fresh_path(s, "region") + ".parquet")
    sink_parquet(_table(s, d, "region").where("r_regionkey < 3"), path)  # a second run takes the place of the first
    return scan(s, path)


def _append(s, d):
    path = fresh_path(s, "log") + ".jsonl"
    for k in range(2):
        append_jsonl(_table(s, d, "region").withColumn("run", F.lit(k)), path)
    return scan(s, path, "r_regionkey int, r_name string, run int")


def _meta(s, d):
    """A log whose header says how many rows follow."""
    path = fresh_path(s, "export") + ".jsonl"
    rows = _table(s, d, "nation")
    append_jsonl(s.createDataFrame([(("1.0", rows.count()),)], "_meta struct<version: string, rows: long>"), path)
    append_jsonl(rows, path)
    header, body = scan_jsonl_meta(s, path, NATION)
    said = header.select(F.get_json_object("value", "$._meta.rows").cast("long").alias("said"))
    return body.crossJoin(F.broadcast(said)).groupBy("said").agg(F.count("*").alias("n"), F.sum("n_nationkey").alias("keys"))


DOC = """name string, problem_statement string, objective string, domain struct<industry string, application string, technology_focus array<string>>, terms struct<must_include array<string>, nice_to_have array<string>, exclude array<string>>,
performance_criteria array<struct<metric string, target string>>, constraints struct<trl struct<min int, max int>, scale string, cost string>, decision_criteria struct<must_have array<string>, nice_to_have array<string>, exclusions array<string>, decision_rules array<string>>, notes string"""
FIELDS = {
    "name": "name", "problem": "problem_statement", "objective": "objective", "industry": "domain.industry", "application": "domain.application", "focus": "domain.technology_focus", "must": "terms.must_include", "nice": "terms.nice_to_have",
    "exclude": "terms.exclude", "metrics": "performance_criteria.metric", "targets": "performance_criteria.target", "trl_min": "constraints.trl.min", "trl_max": "constraints.trl.max", "scale": "constraints.scale", "cost": "constraints.cost",
    "must_have": "decision_criteria.must_have", "nice_have": "decision_criteria.nice_to_have", "exclusions": "decision_criteria.exclusions", "notes": "notes",
}


def _flat(s, d):
    rows = s.read.schema(DOC).json(_docs_path(s, d)).select(*[F.col(p).alias(n) for n, p in FIELDS.items()])
    return rows.select(*[F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes])


def _docs_path(s, d) -> str:
    path = fresh_path(s, "briefs")
    _documents(s, d).write.json(path)
    return path


def _documents(s, d) -> DataFrame:
    b = C.view_frame(s, "briefs", lambda t: _table(s, d, t))
    none = F.lit(None)
    return b.select(
        F.col("silo").alias("name"), F.col("prob").alias("problem_statement"), F.col("obj").alias("objective"), F.struct(F.col("dom").alias("industry"), none.cast("string").alias("application"), F.array("dom").alias("technology_focus")).alias("domain"),
        F.struct(F.col("must").alias("must_include"), F.col("nice").alias("nice_to_have"), F.col("exclude")).alias("terms"), F.array(F.struct(F.lit("yield").alias("metric"), F.lit("> 3 %").alias("target"))).alias("performance_criteria"),
        F.when(F.col("item_id") % 3 != 0, F.struct(F.struct((F.col("item_id") % 4).cast("int").alias("min"), F.lit(9).alias("max")).alias("trl"), F.lit("pilot").alias("scale"), none.cast("string").alias("cost"))).alias("constraints"),
        F.struct(F.col("must").alias("must_have"), F.col("nice").alias("nice_to_have"), F.col("exclude").alias("exclusions"), F.array(F.lit("all")).alias("decision_rules")).alias("decision_criteria"), none.cast("string").alias("notes"),
    )


def _json_docs(s, d):
    """Every document in a file of its own, over many lines, read as such."""
    folder = fresh_path(s, "document")
    text = _documents(s, d).select(F.col("name").alias("of"), F.to_json(F.struct("*"), {"pretty": "true"}).alias("value"))
    text.repartition("of").write.partitionBy("of").text(folder)  # a folder a document: its name is unique
    got = scan_json_docs(s, folder, DOC, {k: FIELDS[k] for k in ("name", "industry", "must", "trl_max")})
    return got.withColumn("must", F.array_join("must", "|"))


def _glob(s, d):
    """A file per region, named by its key; each row's key must be its file's."""
    folder = fresh_path(s, "regions")
    keys = [r[0] for r in _table(s, d, "region").select("r_regionkey").orderBy("r_regionkey").collect()]  # a row a file
    jvm = s.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
    for k in keys:
        part = f"{folder}/part-{k}"
        _table(s, d, "nation").where(F.col("n_regionkey") == k).coalesce(1).write.parquet(part)
        source = next(x.getPath() for x in fs.listStatus(jvm.org.apache.hadoop.fs.Path(part)) if x.getPath().getName().endswith(".parquet"))
        fs.rename(source, jvm.org.apache.hadoop.fs.Path(f"{folder}/{k}.parquet"))
        fs.delete(jvm.org.apache.hadoop.fs.Path(part), True)
    return scan_glob(s, f"{folder}/*.parquet", "n_regionkey").select("n_regionkey", "n_nationkey")


def _registered(s, d):
    register(s)
    rows = C.view_frame(s, "scored", lambda t: _table(s, d, t))
    return s.sql(
        "SELECT silo, round(tied_auc(y, s), 6) AS auc, light_stem(concat(silo, 'sses')) AS stem FROM {rows} GROUP BY silo", rows=rows
    )


def _udtf(s, d):
    register(s)
    return s.sql("SELECT c.conv_id, c.turn, t.place, t.span FROM {talk} c, LATERAL spans(c.text) t", talk=_table(s, d, "conversations"))


def _range(s, d):
    """Papers in the length bands of the regions' keys."""
    bands = _table(s, d, "region").select(F.col("r_name").alias("band"), (F.col("r_regionkey") * 400).alias("low"), (F.col("r_regionkey") * 400 + 500).alias("high"))
    return range_join(_table(s, d, "documents").select("doc_id", "n_chars"), bands, "n_chars", "low", "high", 250).groupBy("band").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def source_flags(papers: DataFrame, tokens: str, most: int = 1000) -> DataFrame:
    """paper_id and a boolean from_<token> for every token of any silo's ``tokens`` (a comma-separated list); an error beyond ``most`` tokens."""
    lists = papers.select("paper_id", F.array_distinct(F.filter(F.transform(F.split(F.coalesce(tokens, F.lit("")), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")).alias("ts"))
    names = [r[0] for r in lists.select(F.explode("ts").alias("t")).distinct().orderBy("t").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"over {most} source tokens")
    return lists.select("paper_id", *[F.array_contains("ts", n).alias(f"from_{n}") for n in names])


def _labelled(s, d):
    from .modelling import prepare_dataset

    return prepare_dataset(_table(s, d, "documents"), _table(s, d, "labels"))


def make_splits(rows: DataFrame) -> DataFrame:
    """60 / 20 / 20 from five grouped folds, per silo's classes: three folds train, one validates, one tests."""
    out = group_folds(rows)
    return out.select("doc_id", "grp", "y", F.when(F.col("fold") < 3, "train").when(F.col("fold") == 3, "val").otherwise("test").alias("split"))


def outer_inner(rows: DataFrame) -> DataFrame:
    """The first of five grouped folds is held out; the rest gets five inner folds of its own."""
    outer = held(group_folds(rows).withColumnRenamed("fold", "outer"), "outer")
    inner = group_folds(outer.where("outer <> 0"), seed=4)
    return outer.where("outer = 0").select("doc_id", "grp", F.lit("holdout").alias("part")).union(inner.select("doc_id", "grp", F.concat(F.lit("fold"), F.col("fold").cast("string"))))


def vectors_of(spark: SparkSession, folder: str, silo: str) -> DataFrame:
    """id, embedding of a silo from its own file <folder>/<silo>.parquet, else from <folder>/pooled.parquet by the id's prefix <silo>__."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{silo}.parquet")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.read.parquet(f"{folder}/{silo}.parquet").select("id", "embedding")
    pooled = spark.read.parquet(f"{folder}/pooled.parquet").where(F.regexp_extract("id", r"^(.*)__", 1) == silo)
    return pooled.select(F.regexp_extract("id", r"__([^_]*)$", 1).alias("id"), "embedding")


def _two_layouts(s, d):
    folder, rows = fresh_path(s, "vectors"), _table(s, d, "embeddings")
    rows.where("label = 1").select(F.col("vec_id").cast("string").alias("id"), "embedding").write.parquet(f"{folder}/1.parquet")
    rows.where("label <> 1").select(F.concat(F.col("label").cast("string"), F.lit("__"), F.col("vec_id").cast("string")).alias("id"), "embedding").write.parquet(f"{folder}/pooled.parquet")
    labels = [r[0] for r in rows.select("label").where("label is not null").distinct().orderBy("label").collect()]  # a row a silo
    parts = [vectors_of(s, folder, str(k)).select(F.lit(k).alias("label"), F.col("id").cast("long").alias("vec_id")) for k in labels]
    return reduce(DataFrame.union, parts)


def _leaks(splits: DataFrame, part: str) -> DataFrame:
    """Rows and groups of each part, and groups that stand in two parts (there must be none)."""
    twice = splits.groupBy("grp").agg(F.countDistinct(part).alias("k")).where("k > 1").agg(F.count("*").alias("crossing"))
    return splits.groupBy(part).agg(F.count("*").alias("n")).crossJoin(F.broadcast(twice))


QUERIES = {
    "scan_csv_or_parquet": _csv, "sink_json": _json, "sink_parquet": _parquet, "append_jsonl": _append, "scan_jsonl_meta": _meta, "scan_json_docs": _json_docs, "scan_glob": _glob, "flatten_brief": _flat, "registered_functions": _registered, "registered_udtf": _udtf,
    "range_join": _range, "join_left_one_to_one": lambda s, d: validated_join(_table(s, d, "documents").select("doc_id"), _table(s, d, "labels").select("doc_id", "quality"), ["doc_id"], "left", "one_to_one"),
    "join_many_to_one": lambda s, d: validated_join(_table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k")), _table(s, d, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment"), ["k"], "inner", "many_to_one").select("o_orderkey", "c_mktsegment"),
    "union_by_name_strict": lambda s, d: union_strict(_table(s, d, "nation").select(F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("name")), _table(s, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("int").alias("id"))),
    "source_flags": lambda s, d: source_flags(_table(s, d, "documents").select(F.col("doc_id").alias("paper_id"), F.concat("lang", F.lit(", "), F.when(F.col("doc_id") % 2 == 0, "Web").otherwise("")).alias("sources")), "sources"),
    "stratified_group_kfold": lambda s, d: group_folds(_labelled(s, d)).select("doc_id", "y", "fold"), "make_splits": lambda s, d: _leaks(held(make_splits(_labelled(s, d)), "splits"), "split"), "outer_inner_split": lambda s, d: _leaks(held(outer_inner(_labelled(s, d)), "parts"), "part"),
    "load_vectors_two_layouts": _two_layouts,
}


LABELLED_SQL = """r AS (SELECT d.doc_id, (1 - quality)::INT AS y, md5(CASE WHEN k = '' THEN 'no_title_' || d.doc_id ELSE k END) AS grp
FROM (SELECT doc_id, trim(lower(split_part(text, chr(10), 1))) AS k FROM documents) d JOIN labels l USING (doc_id) WHERE quality IS NOT NULL)"""


def _dealt_sql(name: str, rows: str, seed: int) -> str:
    """CTEs that deal the groups of ``rows`` one by one: <name> has grp and fold (from 1)."""
    cost = "sqrt(5 * ({q} + {v} * (2 * d.{a}[f] + {v})) - ({s} + {v}) * ({s} + {v})) / {t}"
    one = lambda a, v, t: cost.format(a=a, v=v, t=t, s=f"list_sum(d.{a})", q=f"list_sum([x * x FOR x IN d.{a}])")
    add = lambda a, v: f"[CASE WHEN f = pick THEN d.{a}[f] + {v} ELSE d.{a}[f] END FOR f IN range(1, 6)]"
    return f"""{name}_g AS (SELECT grp, sum(y)::BIGINT AS p, (count(*) - sum(y))::BIGINT AS q, md5('{seed}:0:' || grp) AS k FROM {rows} GROUP BY grp),
{name}_o AS (SELECT *, row_number() OVER (ORDER BY -abs(p - q), p, p + q, k) AS i, greatest(1, sum(p) OVER ()) AS tp, greatest(1, sum(q) OVER ()) AS tq FROM {name}_g),
{name}_d AS (SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS a, [0, 0, 0, 0, 0]::BIGINT[] AS b, 0::BIGINT AS pick UNION ALL
  SELECT i, {add('a', 'p')}, {add('b', 'q')}, pick FROM (SELECT o.i, o.p, o.q, d.a, d.b, list_min([{{'s': round(({one('a', 'o.p', 'o.tp')} + {one('b', 'o.q', 'o.tq')}) / 10, 12), 'n': d.a[f] + d.b[f], 'f': f}} FOR f IN range(1, 6)]).f AS pick FROM {name}_d d JOIN {name}_o o ON o.i = d.i + 1) d),
{name} AS (SELECT grp, pick AS fold FROM {name}_d JOIN {name}_o USING (i))"""


def _split_oracles() -> dict[str, str]:
    begin = f"WITH RECURSIVE {LABELLED_SQL}, {_dealt_sql('f', 'r', 3)}"
    crossing = "(SELECT count(*) FROM (SELECT grp FROM s GROUP BY grp HAVING count(DISTINCT part) > 1))"
    inner = _dealt_sql("h", "e", 4)
    return {
        "stratified_group_kfold": f"{begin} SELECT doc_id, y, (fold - 1)::INT AS fold FROM r JOIN f USING (grp)",
        "make_splits": f"{begin}, s AS (SELECT grp, CASE WHEN fold <= 3 THEN 'train' WHEN fold = 4 THEN 'val' ELSE 'test' END AS part FROM r JOIN f USING (grp)) SELECT part AS split, count(*) AS n, {crossing} AS crossing FROM s GROUP BY part",
        "outer_inner_split": f"{begin}, e AS (SELECT r.* FROM r JOIN f USING (grp) WHERE fold > 1), {inner}, s AS (SELECT grp, 'holdout' AS part FROM r JOIN f USING (grp) WHERE fold = 1 UNION ALL SELECT grp, 'fold' || (fold - 1) FROM e JOIN h USING (grp)) SELECT part, count(*) AS n, {crossing} AS crossing FROM s GROUP BY part",
    }


def oracles() -> dict[str, str]:
    b = C.sql_views("briefs")
    flags = ", ".join(f"lang = '{x}' AS from_{x}" for x in ("de", "en", "es", "fr"))
    return _split_oracles() | {
        "scan_csv_or_parquet": "SELECT n_nationkey, n_name FROM nation", "sink_json": "SELECT n_nationkey, n_name, n_regionkey FROM nation", "sink_parquet": "SELECT r_regionkey, r_name FROM region WHERE r_regionkey < 3",
        "append_jsonl": "SELECT r_regionkey, r_name, k AS run FROM region CROSS JOIN (SELECT unnest([0, 1]) AS k)", "scan_jsonl_meta": "SELECT count(*) AS said, count(*) AS n, sum(n_nationkey) AS keys FROM nation",
        "scan_json_docs": f"WITH {b} SELECT silo AS name, dom AS industry, array_to_string(must, '|') AS must, CASE WHEN item_id % 3 <> 0 THEN 9 END AS trl_max FROM briefs", "scan_glob": "SELECT n_regionkey, n_nationkey FROM nation",
        "flatten_brief": f"WITH {b}, x AS (SELECT *, array_to_string(must, '|') AS m, array_to_string(nice, '|') AS n, array_to_string(exclude, '|') AS e, item_id % 3 <> 0 AS c FROM briefs) SELECT silo AS name, prob AS problem, obj AS objective, dom AS industry, NULL AS application, dom AS focus, m AS must, n AS nice, e AS exclude, 'yield' AS metrics, '> 3 %' AS targets, CASE WHEN c THEN item_id % 4 END AS trl_min, CASE WHEN c THEN 9 END AS trl_max, CASE WHEN c THEN 'pilot' END AS scale, NULL AS cost, m AS must_have, n AS nice_have, e AS exclusions, NULL AS notes FROM x",
        "registered_functions": f"WITH {C.sql_views('ranked')} SELECT silo, round((sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2e0) / nullif(sum(y) * 1e0 * (count(*) - sum(y)), 0), 6) AS auc, silo || 'ss' AS stem FROM ranked GROUP BY silo",
        "range_join": "SELECT r_name AS band, count(*) AS n, min(doc_id) AS first_id FROM region JOIN documents ON n_chars >= r_regionkey * 400 AND n_chars < r_regionkey * 400 + 500 GROUP BY r_name",
        "streaming_label_counts": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS count FROM events GROUP BY ALL", "registered_udtf": "WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(regexp_replace(trim(text), '([.!?])[ \t\n\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM conversations) SELECT conv_id, turn, unnest(range(len(s)))::INT AS place, unnest(s) AS span FROM t",
        "source_flags": f"SELECT doc_id AS paper_id, {flags}, doc_id % 2 = 0 AS from_web FROM documents", "load_vectors_two_layouts": "SELECT label, vec_id FROM embeddings WHERE label IS NOT NULL",
    }
