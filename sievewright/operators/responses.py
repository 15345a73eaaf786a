"""Responses of a screening model: parsing, scoring by log probabilities, cached calls through an injected client.

A client is any picklable callable (request: dict) -> dict with "text" and, where known, "cost" and "logprobs"; it may raise.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalogue import CATALOGUE as C
from ..plans.held import fresh_path, held

#: Labels of a response, lower case, and the verdict they give.
VERDICTS = {"relevant": 1, "yes": 1, "include": 1, "not relevant": 0, "not_relevant": 0, "irrelevant": 0, "no": 0, "exclude": 0}
VERDICT_KEYS = ("relevance", "label")
_decoder = json.JSONDecoder()


def objects(text: str) -> Iterator[dict]:
    """The JSON objects that stand in ``text``, outermost, in order: a decoder is tried at each opening brace, and what it took is skipped."""
    at = text.find("{")
    while at >= 0:
        try:
            value, end = _decoder.raw_decode(text, at)
        except (ValueError, RecursionError):
            end = at + 1
        else:
            yield value
        at = text.find("{", end)


def answer(text: str | None) -> dict | None:
    """The answer of a response: the last object with a verdict key, else the first object; None without one."""
    found = list(objects(text or ""))
    judged = [o for o in found if any(k in o for k in VERDICT_KEYS)]
    return judged[-1] if judged else next(iter(found), None)


def answers(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if (a := answer(t)) is None else json.dumps(a, sort_keys=True))


def with_answer(rows: DataFrame, text: str = "raw", out: str = "answer") -> DataFrame:
    """``rows`` with the answer as JSON: clean responses are parsed on the JVM, only the others go to Python."""
    clean = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\s*```(?:json)?\s*|\s*```\s*$", ""))
    parsed = F.try_parse_json(clean)
    whole = clean.rlike(r"^\{[^{}]*\}$") & parsed.isNotNull()  # one flat object and nothing else
    rest = F.pandas_udf(answers, "string")(F.when(~F.coalesce(whole, F.lit(False)), F.col(text)))
    return rows.withColumn(out, F.when(F.coalesce(whole, F.lit(False)), F.to_json(parsed)).otherwise(rest))


def parse_screening(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``answer``) plus score (relevance of 0 to 100, clamped, over 100), pred and parsed; what does not parse is null, never one half."""
    value = F.try_parse_json("answer")
    relevance = F.try_variant_get(value, "$.relevance", "double")
    label = F.lower(F.trim(F.try_variant_get(value, "$.label", "string")))
    verdict = F.create_map(*[F.lit(x) for kv in VERDICTS.items() for x in kv])
    score = F.when(relevance.isNotNull() & ~F.isnan(relevance), F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), relevance)) / 100, 6))
    return rows.select("*", score.alias("score"), F.try_element_at(verdict, label).alias("pred")).withColumn("parsed", F.col("score").isNotNull() | F.col("pred").isNotNull())


def parse_legacy(rows: DataFrame) -> DataFrame:
    """proba and pred of the older form {"relevant": bool, "confidence": 0..1}: confidence, clamped, of the verdict; (0, .5) where it does not parse."""
    value = F.try_parse_json("answer")
    yes = F.try_variant_get(value, "$.relevant", "boolean")
    sure = F.try_variant_get(value, "$.confidence", "double")
    sure = F.when(sure.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), sure)))
    return rows.select("*", F.round(F.when(yes.isNull() | sure.isNull(), 0.5).when(yes, sure).otherwise(1 - sure), 6).alias("proba"), F.coalesce(yes, F.lit(False)).cast("int").alias("pred"))


def parse_logprob(positions: list[list[tuple[str, float]]] | None, first: int = 6) -> tuple[float, float] | None:
    """(score, log odds) from the first of ``first`` positions that offers a yes or no token.

    A side that the listed tokens leave out is censored: one below the least listed log probability.
    """
    for offered in (positions or [])[:first]:
        sides: dict[str, list[float]] = {"YES": [], "NO": []}
        for token, lp in offered:
            word = token.strip().upper()
            if word in sides and lp is not None:
                sides[word].append(lp)
        if sides["YES"] or sides["NO"]:
            floor = min(lp for _, lp in offered if lp is not None) - 1
            total = {k: math.log(sum(map(math.exp, v))) if v else floor for k, v in sides.items()}
            odds = total["YES"] - total["NO"]
            return 1 / (1 + math.exp(-odds)), odds
    return None


def logprob_scores(rows: DataFrame, column: str = "logprobs", first: int = 6) -> DataFrame:
    """``rows`` with score and logodds of a column array<array<struct<token, logprob>>>: the rule of :func:`parse_logprob`, on the JVM."""
    side = lambda p, w: F.filter(p, lambda t: (F.upper(F.trim(t["token"])) == w) & t["logprob"].isNotNull())
    head = F.slice(F.coalesce(F.col(column), F.array().cast(dict(rows.dtypes)[column])), 1, first)
    hit = F.try_element_at(F.filter(head, lambda p: (F.size(side(p, "YES")) > 0) | (F.size(side(p, "NO")) > 0)), F.lit(1))
    rows = rows.withColumn("_hit", hit)
    total = lambda w: F.aggregate(side(F.col("_hit"), w), F.lit(0.0), lambda s, t: s + F.exp(t["logprob"]))
    floor = F.array_min(F.transform("_hit", lambda t: t["logprob"])) - 1
    part = lambda w: F.when(total(w) > 0, F.ln(total(w))).otherwise(floor)
    odds = F.when(F.col("_hit").isNotNull(), part("YES") - part("NO"))
    return rows.withColumn("logodds", F.round(odds, 6)).withColumn("score", F.round(1 / (1 + F.exp(-odds)), 6)).drop("_hit")


def cache_key(request: dict) -> str:
    """SHA-256 of the request as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(request, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def call(client: Callable[[dict], dict], request: dict, tries: int = 4, wait: float = 0.5, droppable: tuple[str, ...] = ("temperature", "seed", "logprobs")) -> dict:
    """One call with retries after growing, jittered waits; parameters that the client rejects (ValueError naming them) are dropped, in order."""
    request, dropped, last = dict(request), [], ""
    rng = random.Random(cache_key(request))
    for n in range(tries + len(droppable)):
        try:
            return {**client(request), "ok": True, "dropped": ",".join(dropped)}
        except ValueError as e:
            last = str(e)
            bad = next((p for p in droppable if p in request and p in last), None)
            if bad is None:
                break
            request.pop(bad)
            dropped.append(bad)
        except Exception as e:  # noqa: BLE001  a client may fail in any way
            last = str(e) or type(e).__name__
            if n + 1 - len(dropped) >= tries:
                break
            time.sleep(wait * 2**n * (0.5 + rng.random()))
    return {"text": None, "ok": False, "error": last, "dropped": ",".join(dropped)}


RESULT = "k string, text string, cost double, ok boolean, error string, dropped string"


def cached_calls(requests: DataFrame, client: Callable[[dict], dict], cache: DataFrame | None = None, tries: int = 4, wait: float = 0.5, tasks: int = 8) -> DataFrame:
    """Results (k, text, cost, ok, error, dropped, cached) of ``requests`` (k, request: JSON): those in ``cache`` are read, the other distinct ones called once.

    Only successes belong into a cache: append ``where("ok and not cached")`` to it.
    """
    asked = requests.select("k", "request").dropDuplicates(["k"])
    known = requests.sparkSession.createDataFrame([], RESULT) if cache is None else cache.where("ok").dropDuplicates(["k"]).select(*[c.split()[0] for c in RESULT.split(", ")])
    todo = asked.join(known.select("k"), "k", "left_anti").repartition(tasks, "k")

    def run(frames):
        for f in frames:
            got = [call(client, json.loads(r), tries, wait) for r in f.request]
            yield pd.DataFrame({"k": f.k, "text": [g.get("text") for g in got], "cost": [g.get("cost") for g in got], "ok": [g["ok"] for g in got], "error": [g.get("error") for g in got], "dropped": [g["dropped"] for g in got]}).astype({"cost": "float64"})

    made = held(todo.mapInPandas(run, RESULT), "calls").withColumn("cached", F.lit(False))  # written: a lost executor repeats no call
    return made.union(known.join(asked.select("k"), "k", "left_semi").withColumn("cached", F.lit(True)))


def score_frame(rows: DataFrame, client: Callable[[dict], dict], request: F.Column, cache: DataFrame | None = None, **how) -> DataFrame:
    """``rows`` with their response parsed: raw, score, pred, parsed, cost, cached, error; one call per distinct request."""
    asked = rows.withColumn("_request", request).withColumn("_k", F.sha2("_request", 256))
    got = cached_calls(asked.select(F.col("_k").alias("k"), F.col("_request").alias("request")), client, cache, **how)
    got = parse_screening(with_answer(got.withColumnRenamed("text", "raw")))
    return asked.join(got.select(F.col("k").alias("_k"), "raw", "score", "pred", "parsed", "cost", "cached", "error"), "_k", "left").drop("_k", "_request")


def induce_rule_set(rows: DataFrame, client: Callable[[dict], dict], per_class: int = 5, seed: int = 7, **how) -> DataFrame:
    """silo, must, nice, exclude, parsed: a brief per silo from ``per_class`` drawn examples of each answer (paper_id, silo, title, y)."""
    from pyspark.sql import Window

    drawn = rows.withColumn("_n", F.row_number().over(Window.partitionBy("silo", "y").orderBy(F.md5(F.concat(F.lit(f"{seed}-"), F.col("paper_id").cast("string")))))).where(F.col("_n") <= per_class)
    line = F.concat(F.when(F.col("y") == 1, "keep: ").otherwise("reject: "), "title")
    prompts = drawn.groupBy("silo").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "_n", line.alias("line")))), lambda x: x["line"]), "\n").alias("prompt"))
    request = F.to_json(F.struct(F.lit("induce").alias("task"), F.col("prompt")))
    asked = prompts.withColumn("request", request).withColumn("k", F.sha2("request", 256))
    got = with_answer(cached_calls(asked, client, **how).withColumnRenamed("text", "raw"))
    value = F.try_parse_json("answer")
    terms = [F.coalesce(F.try_variant_get(value, f"$.{f}", "array<string>"), F.array().cast("array<string>")).alias(f) for f in ("must", "nice", "exclude")]
    return asked.select("silo", "k").join(got.select("k", *terms, F.col("answer").isNotNull().alias("parsed")), "k").drop("k")


class EchoClient:
    """A client without a network: relevance from the request's length, in one of several forms; now and then it fails at first."""

    def __call__(self, request: dict) -> dict:
        if "logprobs" in request:
            raise ValueError("logprobs is not known here")
        n = len(request.get("prompt", ""))
        if request.get("task") == "induce":
            words = sorted(set(re.findall("[a-z]{4,}", request["prompt"].lower())))
            return {"text": json.dumps({"must": words[:3], "nice": words[3:5], "exclude": words[-1:]}), "cost": 0.01}
        body = json.dumps({"relevance": n % 121, "label": ("relevant", "not relevant", "unsure")[n % 3]})
        return {"text": (body, f"```json\n{body}\n```", f"Let me see. {body} Done.", "I cannot say.")[n % 4], "cost": n / 1e6}


#: Raw responses as models give them: clean, fenced, in prose, two answers, broken, blank, null, out of range.
RAW = """CASE conv_id % 9 WHEN 0 THEN concat('{"relevance": ', r, ', "label": "', l, '"}') WHEN 1 THEN concat('```json', chr(10), '{"relevance": ', r, ', "label": "', l, '"}', chr(10), '```')
  WHEN 2 THEN concat('Well. {"note": "a } brace"} so {"label": "', l, '", "relevance": ', r, '} ok') WHEN 3 THEN concat('{"relevance": 1} then {"relevance": ', r, '}') WHEN 4 THEN concat('{"relevance": ', r, ', "label"')
  WHEN 5 THEN '' WHEN 6 THEN NULL WHEN 7 THEN concat('{"label": "', upper(l), '"}') ELSE concat('{"relevance": -', r, ', "label": "', l, '"}') END"""
C.view("responses")(lambda d: f"SELECT conv_id, turn, role, {RAW} AS raw FROM (SELECT *, CAST((conv_id * 7 + turn) % 140 AS {'VARCHAR' if d.name == 'duckdb' else 'STRING'}) AS r, CASE turn % 3 WHEN 0 THEN 'Relevant' WHEN 1 THEN 'not relevant' ELSE 'unclear' END AS l FROM conversations) q")


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.view_frame(spark, "responses", lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))


def _parsed(spark, sf_dir):
    return parse_screening(with_answer(_responses(spark, sf_dir)))


def _legacy(spark, sf_dir):
    raw = _responses(spark, sf_dir).select("conv_id", "turn", F.when(F.col("conv_id") % 9 == 5, "?").otherwise(F.concat(F.lit('{"confidence": '), (F.col("turn") % 13 / 10).cast("string"), F.lit(', "relevant": '), (F.col("conv_id") % 2 == 0).cast("string"), F.lit("}"))).alias("raw"))
    return parse_legacy(with_answer(raw)).select("conv_id", "turn", "proba", "pred")


def _logprob(spark, sf_dir):
    token = lambda t, p: F.struct(F.lit(t).alias("token"), p.cast("double").alias("logprob"))
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn")
    yes, no = -(F.col("conv_id") % 7 + 1) / 4, -(F.col("turn") % 5 + 1) / 3
    before = F.array(token("The", F.lit(-0.1)), token("A", F.lit(-3.0)))
    both = F.array(token(" yes", yes), token("NO", no), token("maybe", F.lit(-9.0)))
    one = F.array(token("Yes", yes), token("perhaps", F.lit(-6.0)))
    shown = F.when(F.col("conv_id") % 4 == 0, F.array(both)).when(F.col("conv_id") % 4 == 1, F.array(before, one)).when(F.col("conv_id") % 4 == 2, F.array(before, before, both, one)).otherwise(F.array(before))
    return logprob_scores(talk.withColumn("logprobs", shown)).select("conv_id", "turn", "score", "logodds")


def _prompted(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.to_json(F.struct(F.lit("screen").alias("task"), F.concat(F.lit("Paper: "), F.split_part("text", F.lit("\n"), F.lit(1))).alias("prompt"), F.lit(1).alias("logprobs"))).alias("request"))


def _score_frame(spark, sf_dir):
    return score_frame(_prompted(spark, sf_dir), EchoClient(), F.col("request"), wait=0.0).select("doc_id", "score", "pred", "parsed", F.round("cost", 6).alias("cost"))


def _cached_call(spark, sf_dir):
    """A first run over even ids fills the cache, a second over all reads it: calls and cost of each."""
    rows = _prompted(spark, sf_dir)
    keyed = rows.select("doc_id", "request", F.sha2("request", 256).alias("k"))
    path = fresh_path(spark, "cache")
    cached_calls(keyed.where("doc_id % 2 = 0"), EchoClient(), wait=0.0).where("ok and not cached").write.parquet(path)
    got = cached_calls(keyed, EchoClient(), spark.read.parquet(path), wait=0.0)
    return got.groupBy("cached").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 6).alias("cost"), F.max("dropped").alias("dropped"))


def _induced(spark, sf_dir):
    tables = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    rows = C.view_frame(spark, "labelled", tables).select("paper_id", F.col("lang").alias("silo"), "title", "y")
    out = induce_rule_set(rows, EchoClient(), wait=0.0)
    return out.select("silo", "parsed", *[F.array_join(c, "|").alias(c) for c in ("must", "nice", "exclude")])


def _compliance(spark, sf_dir):
    rows = _parsed(spark, sf_dir).withColumn("cell", F.col("conv_id") % 4)
    return rows.groupBy("cell").agg(F.count("*").alias("n"), F.round(F.avg(F.col("parsed").cast("double")), 6).alias("parse_rate"), F.round(F.sum(F.length("raw")) / 1e6, 6).alias("spend"), F.round(F.percentile(F.length("raw"), F.lit(0.5)), 3).alias("p50"), F.round(1 - F.countDistinct("score") / F.nullif(F.count("score"), F.lit(0)), 6).alias("tie_frac"))


def _cells(spark, sf_dir):
    """AUC, cover and mean score of each cell against labels; a document's responses are those whose conv_id is its doc_id."""
    from .evaluation import tied_auc

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("conv_id"), (1 - F.col("quality")).alias("y"))
    rows = held(_parsed(spark, sf_dir).join(labels, "conv_id").withColumn("cell", F.col("turn") % 2), "cells")
    cover = rows.groupBy("cell").agg(F.count("*").alias("n_rows"), F.round(F.count("score") / F.count("*"), 6).alias("coverage"), F.round(F.avg("score"), 6).alias("mean_score"))
    return cover.join(tied_auc(rows, ["cell"]).select("cell", "auc"), "cell", "left")


QUERIES = {
    "extract_json": lambda s, d: with_answer(_responses(s, d)).select("conv_id", "turn", F.try_variant_get(F.try_parse_json("answer"), "$.relevance", "double").alias("relevance"), F.col("answer").isNotNull().alias("found")),
    "parse_screening": lambda s, d: _parsed(s, d).select("conv_id", "turn", "score", "pred", "parsed"), "parse_llm_response_legacy": _legacy, "parse_logprob": _logprob, "cached_call": _cached_call, "score_frame": _score_frame,
    "induce_rule_set": _induced, "own_arm_compliance": _compliance, "llm_cell_metrics": _cells,
}

_KEYS = "SELECT conv_id, turn, raw, conv_id % 9 AS kind, (conv_id * 7 + turn) % 140 AS r, CASE turn % 3 WHEN 0 THEN 'relevant' WHEN 1 THEN 'not relevant' ELSE 'unclear' END AS l FROM responses"
_FORM = f"""SELECT *, CASE WHEN kind IN (0, 1, 2, 3) THEN r::DOUBLE WHEN kind = 8 THEN -r::DOUBLE END AS relevance, CASE WHEN kind IN (0, 1, 2, 7, 8) THEN l END AS label, kind IN (0, 1, 2, 3, 7, 8) AS found FROM ({_KEYS})"""
_SCORED = f"SELECT *, CASE WHEN relevance IS NOT NULL THEN round(least(100, greatest(0, relevance)) / 100, 6) END AS score, CASE label WHEN 'relevant' THEN 1 WHEN 'not relevant' THEN 0 END AS pred FROM ({_FORM})"


def oracles() -> dict[str, str]:
    views = C.sql_views("responses")
    p = f"WITH {views}, s AS (SELECT *, score IS NOT NULL OR pred IS NOT NULL AS parsed FROM ({_SCORED}))"
    lp = """WITH t AS (SELECT conv_id, turn, conv_id % 4 AS k, -(conv_id % 7 + 1) / 4e0 AS yes, -(turn % 5 + 1) / 3e0 AS no FROM conversations),
o AS (SELECT conv_id, turn, CASE k WHEN 0 THEN yes - no WHEN 1 THEN yes - (least(yes, -6) - 1) WHEN 2 THEN yes - no END AS odds FROM t) SELECT conv_id, turn, round(odds, 6) AS logodds, round(1 / (1 + exp(-odds)), 6) AS score FROM o"""
    title = "length('Paper: ' || split_part(text, chr(10), 1))"
    frame = f"WITH q AS (SELECT doc_id, {title} AS n FROM documents) SELECT doc_id, CASE WHEN n % 4 < 3 THEN round(least(n % 121, 100) / 100e0, 6) END AS score, CASE WHEN n % 4 < 3 THEN CASE n % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END END AS pred, n % 4 < 3 AS parsed, round(n / 1e6, 6) AS cost FROM q"
    cached = f"WITH q AS (SELECT split_part(text, chr(10), 1) AS t, {title} AS n, bool_or(doc_id % 2 = 0) AS cached FROM documents GROUP BY ALL) SELECT cached, count(*) AS n, round(sum(n / 1e6), 6) AS cost, 'logprobs' AS dropped FROM q GROUP BY cached"
    return {
        "extract_json": f"WITH {views} SELECT conv_id, turn, relevance, found FROM ({_FORM})", "parse_screening": f"{p} SELECT conv_id, turn, score, pred, parsed FROM s",
        "parse_llm_response_legacy": "SELECT conv_id, turn, CASE WHEN conv_id % 9 = 5 THEN 0.5e0 WHEN conv_id % 2 = 0 THEN round(least(1e0, turn % 13 / 1e1), 6) ELSE round(1 - least(1e0, turn % 13 / 1e1), 6) END AS proba, CASE WHEN conv_id % 9 <> 5 AND conv_id % 2 = 0 THEN 1 ELSE 0 END AS pred FROM conversations",
        "parse_logprob": lp, "score_frame": frame, "cached_call": cached,
        "own_arm_compliance": f"{p} SELECT conv_id % 4 AS cell, count(*) AS n, round(avg(parsed::INT), 6) AS parse_rate, round(sum(length(raw)) / 1e6, 6) AS spend, round(quantile_cont(length(raw), 0.5), 3) AS p50, round(1 - count(DISTINCT score) / nullif(count(score), 0), 6) AS tie_frac FROM s GROUP BY 1",
        "llm_cell_metrics": f"{p}, j AS (SELECT s.*, turn % 2 AS cell, 1 - quality AS y FROM s JOIN labels ON doc_id = conv_id), r AS (SELECT cell, y, rank() OVER (PARTITION BY cell ORDER BY score) + (count(*) OVER (PARTITION BY cell, score) - 1) / 2e0 AS r FROM j WHERE score IS NOT NULL), a AS (SELECT cell, round((sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2e0) / nullif(sum(y) * 1e0 * (count(*) - sum(y)), 0), 6) AS auc FROM r GROUP BY cell) SELECT j.cell, count(*) AS n_rows, round(count(score) / count(*), 6) AS coverage, round(avg(score), 6) AS mean_score, any_value(auc) AS auc FROM j LEFT JOIN a USING (cell) GROUP BY j.cell",
    }
