"""DataFrame operators against hand-made and brute-force results, and plans on tables of edge cases."""

import itertools
import json
import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import sievewright.queries  # noqa: F401  the plans
from sievewright.functions import vectors as nv
from sievewright.functions.joins import range_join, union_strict, validated_join
from sievewright.operators import connectors, embedding, evaluation, experiments, lexblock, responses, specs
from sievewright.plans.catalogue import CATALOGUE
from sievewright.sources.scans import scan, scan_glob, scan_jsonl_meta
from sievewright.sources.sinks import append_jsonl, sink_parquet
from sievewright.streaming.counts import run_to_table, windowed_counts


def test_answers():
    cases = {
        'x {"a": "}"} y {"label": "no", "b": {"c": 1}} z': {"label": "no", "b": {"c": 1}}, '```json\n{"relevance": 3}\n```': {"relevance": 3}, "none": None, None: None, '{"relevance": 1} {"note": 2}': {"relevance": 1},
        '{"a": {"relevance": 5}} {"b": 1}': {"a": {"relevance": 5}}, '{"broken": "': None, '{ {"label": "yes"}': {"label": "yes"}, "{" * 2000: None,
    }
    for text, want in cases.items():
        assert responses.answer(text) == want


def test_responses_parse_alike(spark):
    raw = ['{"relevance": 40, "label": "Relevant"}', '```json\n{"relevance": 400}\n```', 'so {"label": " NO "} ok', "", None, '{"relevance": "x"}', '{"relevance": null, "label": "maybe"}', '{"relevance": 1} {"relevance": 7}']
    rows = spark.createDataFrame(list(enumerate(raw)), "i int, raw string")
    got = [(r.score, r.pred, r.parsed) for r in responses.parse_screening(responses.with_answer(rows)).orderBy("i").collect()]
    assert got == [(0.4, 1, True), (1.0, None, True), (None, 0, True), (None, None, False), (None, None, False), (None, None, False), (None, None, False), (0.07, None, True)]


def test_logprobs(spark):
    lists = [[[("The", -0.1)], [(" yes", -1.0), ("NO", -2.0), ("YES", -3.0)]], [[("No", -0.5), ("x", -4.0)]], [[("a", -1.0)]] * 6 + [[("yes", -1.0)]], [], None]
    rows = spark.createDataFrame(list(enumerate(lists)), "i int, logprobs array<array<struct<token: string, logprob: double>>>")
    got = [r.logodds for r in responses.logprob_scores(rows).orderBy("i").collect()]
    want = [responses.parse_logprob(x) for x in lists]
    assert [None if w is None else round(w[1], 6) for w in want] == got
    assert got[0] == round(math.log(math.exp(-1) + math.exp(-3)) + 2, 6) and got[1] == -4.5 and got[2:] == [None, None, None]


def test_calls_retry_drop_and_cache(spark):
    seen = []

    def client(request):
        seen.append(dict(request))
        if "seed" in request:
            raise ValueError("seed is not supported")
        if len(seen) < 4:
            raise TimeoutError("busy")
        return {"text": "ok"}

    got = responses.call(client, {"prompt": "p", "seed": 1}, wait=0.0)
    assert got["ok"] and got["dropped"] == "seed" and len(seen) == 4

    def failing(request):
        raise TimeoutError("busy")

    assert not responses.call(failing, {"prompt": "p"}, tries=2, wait=0.0)["ok"]
    asked = spark.createDataFrame([("a", json.dumps({"prompt": "1234"})), ("a", json.dumps({"prompt": "1234"})), ("b", json.dumps({"prompt": "12"}))], "k string, request string")
    first = responses.cached_calls(asked, responses.EchoClient(), wait=0.0, tasks=2)
    cache = spark.createDataFrame(first.where("ok").drop("cached").toPandas(), responses.RESULT)
    assert {(r.k, r.cached) for r in first.collect()} == {("a", False), ("b", False)}
    assert {(r.k, r.cached) for r in responses.cached_calls(asked, failing, cache, tries=1).collect()} == {("a", True), ("b", True)}


def test_validated_joins(spark):
    one, twice = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, x string"), spark.createDataFrame([(1, "p"), (1, "q")], "k int, y string")
    assert validated_join(one, twice, ["k"], "left", "one_to_many").count() == 4
    for how in ("one_to_one", "many_to_one"):
        with pytest.raises(ValueError):
            validated_join(one, twice, ["k"], "left", how)
    with pytest.raises(ValueError):
        union_strict(one, twice)
    assert union_strict(one, one.select("x", "k")).count() == 6
    points, bands = spark.createDataFrame([(i / 3,) for i in range(-20, 60)] + [(None,)], "at double"), spark.createDataFrame([("a", -4.0, 3.0), ("b", 2.0, 2.5), ("c", 5.0, 5.0)], "n string, low double, high double")
    got = range_join(points, bands, "at", "low", "high", 1.0)
    assert got.count() == sum(lo <= i / 3 < hi for i in range(-20, 60) for lo, hi in ((-4, 3), (2, 2.5), (5, 5)))


def test_sources(spark, tmp_path):
    nation = spark.createDataFrame([(1, "a,b"), (2, 'c"d'), (3, None)], "k int, name string")
    for k in (1, 2, 3):
        part = nation.where(F.col("k") == k).toPandas()
        part.to_parquet(f"{tmp_path}/{k}.parquet", index=False)
    assert scan_glob(spark, f"{tmp_path}/*.parquet", "k", schema="k long, name string").count() == 3
    pd.DataFrame({"k": [9], "name": ["x"]}).to_parquet(f"{tmp_path}/4.parquet", index=False)
    with pytest.raises(ValueError):
        scan_glob(spark, f"{tmp_path}/*.parquet", "k", schema="k long, name string")
    with pytest.raises(ValueError):
        scan(spark, f"{tmp_path}/x.xlsx")
    path = str(tmp_path / "log.jsonl")
    append_jsonl(spark.createDataFrame([(("1",),)], "_meta struct<version: string>"), path)
    append_jsonl(nation, path)
    header, rows = scan_jsonl_meta(spark, path, "k int, name string")
    assert header.count() == 1 and sorted(map(tuple, rows.collect())) == [(1, "a,b"), (2, 'c"d'), (3, None)]
    sink_parquet(nation, f"{tmp_path}/out.parquet")
    assert sink_parquet(nation.limit(1), f"{tmp_path}/out.parquet") and scan(spark, f"{tmp_path}/out.parquet", columns=["k"]).columns == ["k"]


def test_lexical_block_edges(spark):
    papers = spark.createDataFrame([(1, "a", "Alkali-Activated binder, CO2/clinker"), (2, "a", ""), (3, "a", None), (4, "b", "binder"), (5, "c", "x")], "paper_id long, silo string, text string")
    briefs = spark.createDataFrame([("a", 1, "binder", "", "x", ["alkali activated", " ", None], [], None), ("b", 2, None, None, None, None, ["binder"], ["BINDER"])], "silo string, item_id int, obj string, prob string, dom string, must array<string>, nice array<string>, exclude array<string>")
    got = {r.paper_id: r for r in lexblock.lexical_block(papers, briefs).collect()}
    assert set(got) == {1, 2, 3, 4} and len(got[1]) == 24
    assert got[1].overlap_must_n == 1 and got[1].overlap_nice_n is None and got[1].has_exclude_terms is False and got[1].n_tokens == 5
    assert got[2].bm25_obj == 0 and got[2].overlap_must_per_1k is None and got[2].overlap_must_frac == 0 and got[3].n_tokens == 0
    assert got[4].overlap_must_n is None and got[4].overlap_nice_frac == 1 and got[4].overlap_excl_n == 1 and got[1].rank_bm25_obj == 1
    with pytest.raises(Exception, match="two silos"):
        lexblock.deranged(briefs.where("silo = 'a'")).collect()


def test_tied_auc_by_pairs(spark):
    rng = np.random.default_rng(0)
    rows = [(g, int(rng.random() < 0.4), float(rng.integers(0, 6))) for g in "ab" for _ in range(60)] + [("c", 1, 1.0), ("a", 1, None)]
    got = {r.g: (r.n, r.auc) for r in evaluation.tied_auc(spark.createDataFrame(rows, "g string, y int, score double"), ["g"]).collect()}
    for g in "ab":
        pos, neg = ([s for h, y, s in rows if h == g and y == c and s is not None] for c in (1, 0))
        want = np.mean([1.0 if p > q else 0.5 if p == q else 0.0 for p, q in itertools.product(pos, neg)])
        assert got[g] == (60, round(want, 6))
    assert got["c"] == (1, None)


def test_small_models():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=200) > 0).astype(int)
    theta = nv.fit_logit(x, y)
    assert nv.auc(y, nv.logit_scores(x, theta)) > 0.95
    s = nv.Scaler(np.array([[1.0, np.nan], [3.0, np.nan], [np.nan, np.nan]]))
    assert s(np.array([[np.nan, 5.0]])).tolist() == [[0.0, 5.0]]
    ends, levels = experiments.isotonic(np.array([1, 2, 3, 4.0]), np.array([0, 1, 0, 1]))
    assert ends == [1.0, 3.0, 4.0] and levels == [0.0, 0.5, 1.0]


def test_small_layouts():
    d = np.array([[0, 1, 2.0], [1, 0, 1], [2, 1, 0]])
    at = nv.stress_layout(d)
    assert abs(np.linalg.norm(at[0] - at[2]) - 2) < 0.05
    assert nv.average_linkage(d) == [(0, 1, 1.0, 2), (2, 3, 1.5, 3)]
    assert nv.neighbour_layout(np.random.default_rng(0).normal(size=(12, 4))).shape == (12, 2)


def test_embedding(spark):
    e = embedding.HashingEmbedder(16)
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b")], "k long, text string")
    got = {r.k: r.embedding for r in embedding.embed_texts(rows, e, "k").collect()}
    assert got[1] == got[3] and not any(got[2]) and abs(np.linalg.norm(got[1]) - 1) < 1e-6
    with pytest.raises(Exception, match="no use case"):
        embedding.use_case_text(spark.createDataFrame([(1, None)], "paper_id long, use_case_name string")).collect()
    v = np.random.default_rng(0).normal(size=(40, 5))
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, [0.0] * 5), (98, None)], "vec_id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = np.linalg.eigvalsh(np.cov(u.T, bias=True) * len(u))[::-1]
    assert np.allclose(embedding.spectrum(frame), want)
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 3, i % 3 + 3))) for i in range(9)] + [(9, None)], "doc_id long, text string")
    f = {r.doc_id: r.factors for r in embedding.tfidf_factors(docs, 2).collect()}
    assert np.allclose(f[0], f[3]) and not np.allclose(f[0], f[1]) and not any(f[9])


def test_spec_checks_and_rewriting(spark):
    table = {r.finding: (r.fires, r.on_sound) for r in specs.selftest(spark).collect()}
    assert len(table) == 11 and all(v == (True, 0) for v in table.values())
    spec = spark.createDataFrame([("a", "Topic", "Find printed sensors", "They drift", ["x y"], None, ["k"], ["Named Thing (NT)", "other"], [("F1", None), ("yield", "3 %")], ["short", "a rule of five words here"], "Prioritise triage")], "silo string, name string, objective string, problem string, must array<string>, nice array<string>, exclude array<string>, focus array<string>, metrics array<struct<metric: string, target: string>>, must_have array<string>, notes string")
    got = specs.optimise(spec).first()
    assert got.objective == "Printed sensors. They drift. Reported outcomes of interest include F1, yield (3 %). a rule of five words here."
    assert got.must == ["x y", "Named Thing (NT)", "other", "yield"] and got.industry == "Named Thing (NT)" and got.application == "Topic"
    assert specs.variants(spec).groupBy("variant").count().count() == 19
    found = specs.classified(specs.spans(spark.createDataFrame([(1, "Yield of at least 5 cycles is good. - such as steel\nshort words\nThe team will address it if the many readers agree on it today.")], "i int, t string"), ["i"], "t"), ["good"])
    assert [(r.label, r.rule, r.dual_fire) for r in found.orderBy("place").collect()] == [("predicate", "comparator", True), ("predicate", "enum", False), ("predicate", "bare", False), ("judgement", "conditional", False)]


def test_grouped_splits_keep_groups(spark):
    rows = spark.createDataFrame([(i, f"g{i // 3}", i % 2) for i in range(300)], "doc_id long, grp string, y int")
    got = connectors.make_splits(rows).toPandas()
    assert (got.groupby("grp").split.nunique() == 1).all() and 0.5 < (got.split == "train").mean() < 0.7


def test_late_rows_of_a_stream(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    schema = "ts timestamp, event_type string, user_id long"
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for batch in ([(at(5), "a", 1), (at(200), "a", 1)], [(at(6), "a", 1), (at(190), "a", 2), (at(400), "b", 1)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        got = run_to_table(windowed_counts(spark.readStream.schema(schema).parquet(source)), out, state)
    rows = sorted((r.start.hour, r.event_type, r.n) for r in got.collect())
    assert rows == [(0, "a", 1), (3, "a", 2)]  # minute 6 came late and is gone, the window of hour 6 is open


EDGE = {
    "documents": ([(1, "Title one\nsome text here", "en", "src1", 24), (2, "", "en", "src1", 0), (3, "Solo", "xx", "src2", 4), (4, "Title one\nother", "en", "src3", 15), (4, "Title one\nother", "en", "src3", 15), (5, "naïve — 漢字", "yy", "src1", 10)], "doc_id long, text string, lang string, source string, n_chars long"),
    "labels": ([(1, 0, 0), (2, 0, 0), (3, 1, 1), (4, 0, None)], "doc_id long, quality int, toxic int"),
    "embeddings": ([(1, [1.0, 0.0] * 64, 0), (2, [0.0] * 128, 0), (3, None, 1), (4, [1.0, 1.0] * 64, 1), (100, [0.5, 1.0] * 64, 1)], "vec_id long, embedding array<float>, label int"),
    "benchmark": ([(1, "alpha beta gamma delta of the some text here"), (2, ""), (3, None)], "item_id long, text string"),
    "conversations": ([(1, 0, "user", "Hi there."), (1, 1, "assistant", None), (2, 0, "user", "")], "conv_id long, turn long, role string, text string"),
}


@pytest.fixture(scope="module")
def edge_tables(spark):
    made = {t: spark.createDataFrame(rows, schema).cache() for t, (rows, schema) in EDGE.items()}
    return lambda t: made[t] if t in made else spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")


@pytest.fixture(scope="module")
def edge_duck(edge_tables):
    import os

    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir("/root/testdata/sf0.001"):
        t = f.removesuffix(".parquet")
        if t in EDGE:
            con.register(f"{t}_rows", edge_tables(t).toArrow())
        con.execute(f"CREATE {'TABLE' if t in EDGE else 'VIEW'} {t} AS SELECT * FROM " + (f"{t}_rows" if t in EDGE else f"'/root/testdata/sf0.001/{f}'"))
    return con


EDGE_PLANS = [n for n in CATALOGUE.plans if any(w in CATALOGUE.sql(n) for w in ("scored", "vectors"))]


@pytest.mark.parametrize("part", range(4))
def test_plans_on_edge_tables(spark, edge_tables, edge_duck, part):
    """One-class and one-row silos, zero, null and 128-wide vectors, null and empty texts, repeated rows: both engines give the same."""
    from sievewright.plans.dialect import DuckSql

    from .test_catalogue import canon

    for name in EDGE_PLANS[part::4]:
        mine, theirs = CATALOGUE.run(spark, name, edge_tables).toPandas(), edge_duck.execute(CATALOGUE.sql(name, DuckSql)).fetchdf()
        assert canon(mine) == canon(theirs), name
