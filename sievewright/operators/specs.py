"""Quality of briefs ("specs"): normalising, linting, mutations, rewriting, and what in their prose can be checked.

A spec row has silo, name, objective, problem, must, nice, exclude, industry, application, focus. Every check is a column expression; no
text leaves the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalogue import CATALOGUE as C
from ..plans.held import held
from .lexblock import _inputs, block_variants, tokens

#: Filler prose, a vague request, words that match almost any paper.
FLUFF = (
    "This work investigates important aspects of the field and makes a significant contribution to the existing literature. A range of relevant factors is considered and "
    "the results are discussed in detail. The findings have implications for practice and further research is needed to explore these issues more fully."
)
VAGUE = "Find interesting and relevant recent work in this area that could be useful to us."
GENERIC = "used using analysis data results significant study based approach effects factors use different higher important".split()
GENERIC_BAR = 0.07
#: Patterns of requests and of praise.
IMPERATIVE = r"(?i)^\s*(find|identify|get|look|search|show|give|fetch|retrieve|locate)\b"
SELF = r"\b(us|we|our|me|my|I)\b"
PRAISE = r"(?i)\b(interesting|relevant|useful|promising|suitable|nice|good)\b"
#: What makes a span of prose checkable or a judgement.
METRIC_HEADS = (
    "strength efficiency capacity accuracy yield selectivity conductivity density lifetime cost consumption emissions penalty loss latency throughput purity durability stability "
    "reduction rate time temperature pressure power energy resistance toughness permeability porosity absorption adsorption degradation conversion recovery performance voltage "
    "current sensitivity specificity mortality prevalence adherence bioavailability tolerance endurance retention shrinkage workability productivity metallization corrosion"
).split()
COMPARATOR = r"(>=|<=|>|<|\bat least\b|\bno more than\b|\bno less than\b)"
COMPARATOR_BROAD = r"(>=|<=|≥|≤|>|<|\bat least\b|\bno more than\b|\bno less than\b)"
ENUM = r"(?:\be\.g\.,?|\bi\.e\.,?|\bsuch as\b)"
CONDITIONAL = r"\b(if|unless|address(?:es)?|relates?\s+to|concerns?)\b"
CONDITIONAL_BROAD = r"\b(if|unless|address(?:es)?|relates?\s+to|concerns?|promising|suitable|directly\s+transferable)\b"
VERB = (
    r"\b(is|are|was|were|be|been|being|am|has|have|had|does|do|did|can|could|may|might|must|shall|should|will|would|address(?:es)?|relates?|concerns?|requires?|reports?|presents?|covers?|"
    r"includes?|benchmarks?|evaluates?|identif(?:y|ies)|predicts?|explores?|reasons?|measures?|improves?|operates?|sustains?|allows?|enables?|uses?|needs?|targets?|exceeds?|achieves?|"
    r"reaches?|focus(?:es)?|screens?|scouts?)\b"
)
UNIT = (
    r"\b\d+(?:\.\d+)?\s?(?:%|mpa|gpa|kpa|w/g|w/kg|kw|mw|gw|wh|kwh|mwh|mj|gj|kj|mg/dl|mmol/l|mg|kg|g/l|ml|°c|tops/w|gops/w|pj|nj|ms|ns|hz|khz|mhz|ghz|mol/kg|mmol/g|m2/g|cm2|nm|mm|years?|months?|weeks?|days?|cycles?)\b"
)
UNIT_BROAD = (
    r"\b\d+(?:\.\d+)?\s?(?:%|mpa|gpa|kpa|w/g|w/kg|kw|mw|gw|wh|kwh|mwh|mj|gj|kj|mg/dl|mmol/l|mg|kg|g/l|ml|°c|k\b|tops/w|gops/w|pj|nj|ms|µs|ns|hz|khz|mhz|ghz|mol/kg|mmol/g|m2/g|cm2|nm|µm|mm|years?|months?|weeks?|days?|hours?|cycles?)\b"
)
#: The judgement words, and those of the broad reading.
JUDGEMENT = (
    "the a an of in on at to for with and or as by this these those that their its our which such both from high higher low lower good better best improved increased "
    "decreased reduced excellent superior optimal significant various different several many most some other also however while review paper study studies research results article recent"
).split()
JUDGEMENT_BROAD = [*JUDGEMENT, "if", "unless", "addresses", "relates to", "promising", "suitable", "directly transferable"]
#: The narrow and the broad reading of a span: judgement words, comparators, conditionals, units.
READINGS = {"narrow": (JUDGEMENT, COMPARATOR, CONDITIONAL, UNIT), "broad": (JUDGEMENT_BROAD, COMPARATOR_BROAD, CONDITIONAL_BROAD, UNIT_BROAD)}
#: Rewriting. Metrics that any paper may report, openings of a request, notes on the process.
GENERIC_METRICS = ("precision", "recall", "f1", "f1 score", "f-score", "f score", "accuracy", "auc", "roc-auc", "roc auc", "auroc", "p-value", "error rate", "rmse", "mae", "mse", "sensitivity", "specificity", "throughput", "latency")
LEADING = r"(?i)^\s*(find|identify|scout|explore|improve|discover|search for|look for|locate|retrieve)\s+"
PROCESS = r"(?i)\b(pool|seeded|canon|analyst|labell?ing|triage|this tool|reference lists)\b|\bprioriti[sz]\w*"
FLOOR, KEYWORD_TOKENS = 5, 3

TEXTS, LISTS = ("name", "objective", "problem", "industry", "application"), ("must", "nice", "exclude", "focus")


def blank_free(col) -> F.Column:
    return F.filter(F.transform(F.coalesce(col, F.array().cast("array<string>")), F.trim), lambda x: x.isNotNull() & (x != ""))


def normalise(specs: DataFrame) -> DataFrame:
    """Nine fields: null texts are "", lists lose null and blank entries; absent columns are empty."""
    have = set(specs.columns)
    text = [F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) if c in have else F.lit("").alias(c) for c in TEXTS]
    lists = [blank_free(F.col(c)).alias(c) if c in have else F.array().cast("array<string>").alias(c) for c in LISTS]
    return specs.select(*[c for c in specs.columns if c not in TEXTS + LISTS], *text, *lists)


def generic_share(text) -> F.Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    return F.size(F.filter(words, lambda w: w.isin(*GENERIC))) / F.greatest(F.size(words), F.lit(1))


def quoted(term) -> F.Column:
    """``term`` as a literal of a regular expression."""
    return F.regexp_replace(term, r"([\\\[\](){}.*+?^$|#&~\-])", r"\\$1")


def asserted(objective, exclude) -> F.Column:
    """Excluded terms that the objective states without a negation right before them."""
    pattern = lambda t: F.concat(F.lit("(?i)"), F.lit(rf"(?<!{'|'.join(_negations())})\b"), quoted(t), F.lit(r"\b"))
    return F.filter(exclude, lambda t: F.rlike(objective, pattern(t)))


def _negations() -> list[str]:
    """The negations spelled out, since a look-behind needs bounded alternatives."""
    return ["non", "non-", "non ", "not ", "no ", "excluding ", "except ", "other than ", "without ", "rather than ", "exclude ", "excludes ", "excluded "]


def instruction_shaped(text) -> F.Column:
    return (F.rlike(text, F.lit(IMPERATIVE)) | F.rlike(text, F.lit(SELF))) & (F.regexp_count(text, F.lit(PRAISE)) >= 2)


def checks() -> list[tuple[str, str, F.Column]]:
    """(id, severity, fires) over normalised specs, in the order of severity."""
    c, size = F.col, lambda x: F.size(F.col(x))
    lower = lambda x: F.transform(x, F.lower)
    empty = (c("objective") == "") & (c("problem") == "") & (c("industry") == "") & (c("application") == "") & (F.size(F.concat("must", "nice", "exclude", "focus")) == 0)
    return [
        ("objective_missing", "blocker", c("objective") == ""), ("only_name", "blocker", (c("name") != "") & empty), ("nice_empty", "blocker", size("nice") == 0), ("must_single", "blocker", size("must") == 1),
        ("nice_single", "warn", size("nice") == 1), ("objective_generic", "warn", generic_share(c("objective")) >= GENERIC_BAR), ("objective_instruction_shaped", "warn", instruction_shaped(c("objective"))),
        ("terms_generic", "warn", F.exists(F.concat("must", "nice"), lambda t: F.lower(t).isin(*GENERIC))), ("must_thin", "warn", size("must").between(2, 4)),
        ("exclude_asserted_in_prose", "warn", F.size(asserted(c("objective"), c("exclude"))) > 0), ("exclude_in_must", "note", F.size(F.array_intersect(lower(c("must")), lower(c("exclude")))) > 0),
    ]


def lint(specs: DataFrame) -> DataFrame:
    """silo, place (0 first: blockers, warnings, notes), severity, finding of every check that fires."""
    each = F.array(*[F.when(fires, F.struct(F.lit(i).alias("n"), F.lit(sev).alias("severity"), F.lit(name).alias("finding"))) for i, (name, sev, fires) in enumerate(checks())])
    found = normalise(specs).select("silo", F.posexplode(F.filter(each, lambda x: x.isNotNull())).alias("place", "f"))
    return found.select("silo", "place", "f.severity", "f.finding")


def escalation(specs: DataFrame) -> DataFrame:
    """silo, findings (blockers and warnings), compound: two of them or more."""
    n = F.count(F.when(F.col("severity") != "note", 1))
    return lint(specs).groupBy("silo").agg(n.alias("findings"), (n >= 2).alias("compound"))


BASE = dict(
    name="Cold chain monitors", objective="Printed sensors for vaccine transport that record temperature over weeks, with drift measured between calibrations.", problem="Loggers cost too much per parcel.",
    must=["printed sensor", "vaccine", "transport", "drift", "calibration"], nice=["cold chain", "logger", "time indicator", "battery free", "field trial"], exclude=["aircraft"], industry="Health", application="Logistics", focus=["Printed electronics"],
)


def selftest_specs(spark: SparkSession) -> DataFrame:
    """A sound spec, and for each check one that must trigger it (silo = the check)."""
    b = BASE
    cases = {
        "sound": b, "objective_missing": b | {"objective": ""}, "only_name": {"name": b["name"]}, "nice_empty": b | {"nice": []}, "must_single": b | {"must": b["must"][:1]}, "nice_single": b | {"nice": b["nice"][:1]},
        "objective_generic": b | {"objective": FLUFF}, "objective_instruction_shaped": b | {"objective": VAGUE}, "terms_generic": b | {"nice": b["nice"] + GENERIC}, "must_thin": b | {"must": b["must"][:3]},
        "exclude_asserted_in_prose": b | {"objective": b["objective"] + " Work on aircraft is welcome."}, "exclude_in_must": b | {"exclude": ["Vaccine"], "objective": "Sensors."},
    }
    schema = "silo string, " + ", ".join(f"{t} string" for t in TEXTS) + ", " + ", ".join(f"{t} array<string>" for t in LISTS)
    return spark.createDataFrame([(k, *[v.get(t, "") for t in TEXTS], *[v.get(t, []) for t in LISTS]) for k, v in cases.items()], schema)


def selftest(spark: SparkSession) -> DataFrame:
    """check, fires on its trigger, and on how many of the other specs: the table of false alarms."""
    found = lint(selftest_specs(spark))
    names = spark.createDataFrame([(n,) for n, _, _ in checks()], "finding string")
    return names.join(found, "finding", "left").groupBy("finding").agg(F.coalesce(F.max(F.col("silo") == F.col("finding")), F.lit(False)).alias("fires"), F.count(F.when(F.col("silo") == "sound", 1)).alias("on_sound"))


def _mutations() -> dict[str, dict[str, F.Column]]:
    none, c, generic = F.array().cast("array<string>"), F.col, F.array(*map(F.lit, GENERIC))
    blank = F.lit("")
    prose = F.when(F.size("exclude") > 0, F.concat(F.regexp_replace(F.trim("objective"), r"\.+$", ""), F.lit(". Note that work on "), F.array_join("exclude", ", "), F.lit(" is directly relevant here and should be treated as a positive signal."))).otherwise(c("objective"))
    flood = {"must": F.concat("must", generic), "nice": F.concat("nice", generic)}
    fluff = {"objective": F.lit(FLUFF), "problem": F.lit(FLUFF)}
    return {
        "full": {}, "no_obj": {"objective": blank}, "no_prob": {"problem": blank}, "no_must": {"must": none}, "no_nice": {"nice": none}, "no_exclude": {"exclude": none}, "no_domain": {"industry": blank, "application": blank, "focus": none},
        "only_name": {"objective": blank, "problem": blank, "industry": blank, "must": none, "nice": none, "exclude": none, "focus": none, "application": c("name")},
        "fluff_replace": fluff, "fluff_added": {f: F.concat(c(f), F.lit(" " + FLUFF)) for f in ("objective", "problem")}, "vague_objective": {"objective": F.lit(VAGUE)}, "conflicting": {"must": F.concat("must", "exclude"), "exclude": none},
        "keyword_flood": flood, "must_only_one": {"must": F.slice("must", 1, 1)}, "nice_only_one": {"nice": F.slice("nice", 1, 1)}, "conflicting_prose": {"objective": prose},
        "fluff_and_flood": fluff | flood, "vague_and_flood": {"objective": F.lit(VAGUE)} | flood, "fluff_and_no_must": fluff | {"must": none},
    }


def variants(specs: DataFrame, names: list[str] | None = None) -> DataFrame:
    """silo, variant and the nine fields of every mutation of every spec (19, or those named)."""
    specs, table = normalise(specs), _mutations()
    parts = [specs.select("silo", F.lit(n).alias("variant"), *[table[n].get(f, F.col(f)).alias(f) for f in TEXTS + LISTS]) for n in (names or table)]
    return reduce(DataFrame.union, parts)


def as_briefs(specs: DataFrame, *more: str) -> DataFrame:
    """The lexical block's view of specs, with ``more`` columns: the domain is industry, application and focus."""
    return specs.select("silo", *more, F.lit(0).alias("item_id"), F.col("objective").alias("obj"), F.col("problem").alias("prob"), F.concat_ws(" ", "industry", "application", F.array_join("focus", " ")).alias("dom"), "must", "nice", "exclude")


UNFITTED = ("bm25_nice", "bm25_obj", "overlap_must_frac")


def variant_blocks(papers: DataFrame, specs: DataFrame, ranks: bool | list[str] = False) -> DataFrame:
    """The lexical block of every paper under each of the 19 variants of its silo's spec."""
    return block_variants(papers, as_briefs(held(variants(specs), "variants"), "variant"), ranks)


def ablation(papers: DataFrame, specs: DataFrame, labels: DataFrame, least: int = 5) -> DataFrame:
    """variant, feature, n_silos, mean AUC over silos of unfitted rankers on the held-out labels (paper_id, y, held).

    A silo counts with ``least`` positives or more among them; a ranker that is null for any of its rows is undefined there."""
    from .evaluation import tied_auc

    block = held(variant_blocks(papers, specs).select("paper_id", "silo", "variant", *UNFITTED).join(labels.where("held"), "paper_id"), "ablation")
    enough = block.groupBy("silo", "variant").agg(F.sum("y").alias("p"), *[F.count_if(F.col(c).isNull()).alias(f"none_{c}") for c in UNFITTED]).where(F.col("p") >= least)
    rows = block.join(enough, ["silo", "variant"])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("score"), (F.col(f"none_{c}") == 0).alias("whole")) for c in UNFITTED]))
    long = rows.select("variant", "silo", "y", each.alias("f")).select("variant", "silo", "y", "f.*").where("whole")
    got = tied_auc(long, ["variant", "silo", "feature"]).groupBy("variant", "feature").agg(F.count("auc").alias("n_silos"), F.round(F.avg("auc"), 6).alias("mean_auc"))
    every = block.select("variant").distinct().select("variant", F.explode(F.array(*map(F.lit, UNFITTED))).alias("feature"))
    return every.join(got, ["variant", "feature"], "left").withColumn("n_silos", F.coalesce("n_silos", F.lit(0).cast("long")))


def ablation_fitted(papers: DataFrame, specs: DataFrame, labels: DataFrame, n_pos: int = 30, n_neg: int = 30, seeds: int = 3, c: float = 0.0005, least: int = 5) -> DataFrame:
    """variant, silo, n_seeds, AUC on the held-out labels of a logistic model over the block, fitted on ``n_pos`` and ``n_neg`` drawn labels of the rest; one pass for all variants.

    The draws are the same for every variant; silos with fewer labels of a class are left out."""
    from . import manymodels
    from .evaluation import tied_auc
    from .folds import draw_order

    block = variant_blocks(papers, specs, True).drop("has_exclude_terms")
    numbers = [x for x in block.columns if x not in ("paper_id", "silo", "variant")]
    rows = held(block.join(labels.hint("merge"), "paper_id").select("paper_id", "silo", "variant", "y", "held", F.array(*numbers).alias("x")), "blocks")
    known = rows.select("paper_id", "silo", "y", "held").distinct()
    sizes = known.groupBy("silo").agg(F.count_if(~F.col("held") & (F.col("y") == 1)).alias("p"), F.count_if(~F.col("held") & (F.col("y") == 0)).alias("n"), F.count_if(F.col("held") & (F.col("y") == 1)).alias("k"))
    silos = held(sizes.where((F.col("p") >= n_pos) & (F.col("n") >= n_neg) & (F.col("k") >= least)).select("silo"), "silos")
    drawn = draw_order(known.where("not held").join(silos, "silo").select("*", F.explode(F.array(*[F.lit(s) for s in range(seeds)])).alias("seed")), ["silo", "seed", "y"], "paper_id", "ablation")
    drawn = drawn.where(F.col("at") < F.when(F.col("y") == 1, n_pos).otherwise(n_neg)).select("paper_id", "seed")
    key = lambda *parts: F.concat_ws("|", *[F.col(p).cast("string") for p in parts])
    cells = rows.join(drawn, "paper_id").select(key("variant", "silo", "seed").alias("cell"), F.col("paper_id").alias("id"), "y", "x")
    packed = manymodels.blocks(cells.union(rows.where("held").join(silos, "silo").select(key("variant", "silo"), "paper_id", "y", "x")))
    models = rows.select("variant", "silo").distinct().join(silos, "silo").select("*", F.explode(F.array(*[F.lit(s) for s in range(seeds)])).alias("seed"))
    models = held(models.withColumn("model", key("variant", "silo", "seed")), "designs")
    state = manymodels.fit(packed, models.select("model", F.lit(c).alias("c"), F.lit(None).cast("array<int>").alias("cols")), models.select("model", F.col("model").alias("cell")))
    got = manymodels.scores(packed, state, models.select("model", key("variant", "silo").alias("cell"))).join(models, "model")
    return tied_auc(got, ["variant", "silo", "seed"]).groupBy("variant", "silo").agg(F.count("auc").alias("n_seeds"), F.round(F.avg("auc"), 6).alias("auc"))


def near_duplicate(a, b) -> F.Column:
    """One holds the other, once parentheses are stripped; blank terms are near nothing."""
    bare = lambda x: F.trim(F.regexp_replace(F.lower(x), r"\([^)]*\)", ""))
    return (bare(a) != "") & (bare(b) != "") & (F.contains(bare(a), bare(b)) | F.contains(bare(b), bare(a)))


def _topped_up(terms, candidates) -> F.Column:
    """``terms``, and candidates that are near none of them while there are fewer than ``FLOOR``; never cut."""
    add = lambda acc, x: F.when((F.size(acc) < FLOOR) & ~F.exists(acc, lambda t: near_duplicate(t, x)), F.concat(acc, F.array(x))).otherwise(acc)
    return F.aggregate(candidates, terms, add)


def optimise(specs: DataFrame) -> DataFrame:
    """The rewritten spec and its provenance: array of (field, action, source).

    specs: the nine fields and metrics (array<struct<metric, target>>), must_have, nice_to_have, exclusions (criteria), notes. A leading request verb goes from the
    objective; the problem, metrics, long criteria and notes on the subject join it; term lists are topped up to ``FLOOR``, never cut; empty domain fields are filled.
    """
    extra = {"metrics": "array<struct<metric:string,target:string>>", "must_have": "array<string>", "nice_to_have": "array<string>", "exclusions": "array<string>", "notes": "string"}
    have = set(specs.columns)
    s = normalise(specs.select("*", *[F.lit(None).cast(t).alias(n) for n, t in extra.items() if n not in have]))
    s = s.withColumns({n: blank_free(F.col(n)) for n in ("must_have", "nice_to_have", "exclusions")}).withColumn("metrics", F.filter(F.coalesce("metrics", F.array().cast(extra["metrics"])), lambda m: F.trim(F.coalesce(m["metric"], F.lit(""))) != ""))
    c = F.col
    sentence = lambda x: F.when((x == "") | F.rlike(x, F.lit("[.!?]$")), x).otherwise(F.concat(x, F.lit(".")))
    bare = F.regexp_replace("objective", LEADING, "")
    bare = F.when(bare != c("objective"), F.concat(F.upper(F.substring(bare, 1, 1)), F.substring(bare, 2, 1 << 30))).otherwise(bare)
    long = F.filter("must_have", lambda x: F.size(F.split(x, r"\s+")) > KEYWORD_TOKENS)
    measured = F.array_distinct(F.transform("metrics", lambda m: F.when(F.trim(F.coalesce(m["target"], F.lit(""))) != "", F.concat(m["metric"], F.lit(" ("), m["target"], F.lit(")"))).otherwise(m["metric"])))
    outcome = F.when(F.size("metrics") > 0, F.concat(F.lit("Reported outcomes of interest include "), F.array_join(measured, ", "), F.lit("."))).otherwise("")
    note = F.trim(F.coalesce("notes", F.lit("")))
    subject = (note != "") & ~F.rlike(note, F.lit(PROCESS)) & ~F.rlike(note, F.lit(LEADING))
    parts = F.filter(F.concat(F.array(sentence(bare), sentence(c("problem")), outcome), F.transform(long, sentence), F.array(F.when(subject, sentence(note)).otherwise(""))), lambda x: x != "")
    named = F.filter(F.transform("metrics", lambda m: F.trim(m["metric"])), lambda m: ~F.lower(m).isin(*GENERIC_METRICS))
    must = _topped_up(c("must"), F.concat("focus", named))
    short = lambda x: F.filter(x, lambda t: F.size(F.split(t, r"\s+")) <= KEYWORD_TOKENS)
    s = s.withColumn("new_must", F.array_distinct(must))
    left = F.filter("focus", lambda x: ~F.exists("new_must", lambda t: near_duplicate(t, x)))
    s = s.withColumn("new_nice", F.array_distinct(_topped_up(c("nice"), F.concat(short("nice_to_have"), left)))).withColumn("new_exclude", F.array_distinct(F.concat("exclude", short("exclusions"))))
    step = lambda when, field, action, source: F.when(when, F.struct(F.lit(field).alias("field"), F.lit(action).alias("action"), F.lit(source).alias("source")))
    steps = F.array(
        step(bare != c("objective"), "objective", "request verb dropped", "objective"), step(c("problem") != "", "objective", "appended", "problem"), step(F.size("metrics") > 0, "objective", "appended", "metrics"), step(F.size(long) > 0, "objective", "appended", "must_have"),
        step(subject, "objective", "appended", "notes"), step((note != "") & ~subject, "objective", "note skipped", "notes"), step(F.size("new_must") > F.size("must"), "must", "topped up", "focus, metrics"), step(F.size("must") >= FLOOR, "must", "left alone", ""),
        step(F.size(named) < F.size("metrics"), "must", "metric skipped", "metrics"), step(F.size("new_nice") > F.size("nice"), "nice", "topped up", "nice_to_have, focus"), step((c("industry") == "") & (F.size("focus") > 0), "industry", "filled", "focus"),
        step((c("application") == "") & (c("name") != ""), "application", "filled", "name"),
    )
    industry = F.when((c("industry") == "") & (F.size("focus") > 0), F.try_element_at("focus", F.lit(1))).otherwise(c("industry"))
    application = F.when(c("application") == "", c("name")).otherwise(c("application"))
    return s.select("silo", "name", F.array_join(parts, " ").alias("objective"), "problem", industry.alias("industry"), application.alias("application"), F.col("new_must").alias("must"), F.col("new_nice").alias("nice"), F.col("new_exclude").alias("exclude"), "focus", F.filter(steps, lambda x: x.isNotNull()).alias("provenance"))


def spans(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, place, span: sentences and list items (lines that open with a dash, star or number) of ``text``."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), r"(?<=[.!?])\s+|\n+")
    clean = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s+", ""))), lambda x: x != "")
    return rows.select(*key, F.posexplode(clean).alias("place", "span"))


def _like(text, pattern: str) -> F.Column:
    """Whatever its case, with letters of all alphabets as letters."""
    return F.rlike(text, F.lit(f"(?iU){pattern}"))


def classified(found: DataFrame, lexicon: list[str] | None = None, reading: str = "narrow") -> DataFrame:
    """``found`` with label, rule and dual_fire: the first rule that fires, and whether one of the other camp fires too. ``lexicon``: other judgement words than the reading's."""
    words, comparator, conditional, _ = READINGS[reading]
    lexicon = words if lexicon is None else lexicon
    t, like = F.col("span"), lambda p: _like(F.col("span"), p)
    judged = like(r"\b(?:" + "|".join(lexicon) + r")\b")
    metric = like(r"\b(?:" + "|".join(sorted(METRIC_HEADS, key=len, reverse=True)) + r")\b") & ~judged
    verb = like(VERB)
    fires = {"comparator": like(comparator) & like(r"\d"), "enum": like(ENUM), "metric": metric, "bare": (F.size(F.split(t, r"\s+")) <= 8) & ~verb, "judgement": judged, "conditional": like(conditional) & verb}
    rule = reduce(lambda acc, kv: acc.when(kv[1], kv[0]), list(fires.items())[1:], F.when(fires["comparator"], "comparator")).otherwise("none")
    predicate = fires["comparator"] | fires["enum"] | fires["metric"] | fires["bare"]
    out = found.select("*", rule.alias("rule"), (predicate & (fires["judgement"] | fires["conditional"])).alias("dual_fire"))
    return out.withColumn("label", F.when(F.col("rule").isin("judgement", "conditional"), "judgement").when(F.col("rule") == "none", "unclassified").otherwise("predicate"))


def checkability(found: DataFrame, key: list[str], least: int = 3) -> DataFrame:
    """key, n (classified), checkable: predicates over predicates and judgements, null with fewer than ``least``."""
    n = F.count(F.when(F.col("label") != "unclassified", 1))
    share = F.count(F.when(F.col("label") == "predicate", 1)) / F.nullif(n, F.lit(0))
    return found.groupBy(*key).agg(n.alias("n"), F.round(F.when(n >= least, share), 6).alias("checkable"), F.count(F.when(F.col("dual_fire"), 1)).alias("n_dual"))


def evidence(papers: DataFrame, vocabulary: DataFrame, reading: str = "narrow") -> DataFrame:
    """silo, n, share of non-null abstracts with a quantity and a word of the silo's vocabulary (silo, words) in one sentence; null without words."""
    rows = papers.where("abstract is not null").join(vocabulary, "silo")
    said = lambda s: F.arrays_overlap(tokens(s), F.col("words"))
    hit = F.exists(F.split("abstract", r"(?<=[.!?])\s+"), lambda s: _like(s, READINGS[reading][3]) & said(s))
    return rows.groupBy("silo").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.size("words") > 0, hit.cast("double"))), 6).alias("share"))


def _specs(s: SparkSession, d: str) -> DataFrame:
    """Specs from the shared briefs, some of them with the defects that the checks look for."""
    b = C.view_frame(s, "briefs", lambda t: s.read.parquet(f"{d}/{t}.parquet"))
    k, none = F.col("item_id") % 11, F.array().cast("array<string>")
    obj = F.when(k == 0, "").when(k == 5, FLUFF).when(k == 6, VAGUE).when(k == 9, F.concat("obj", F.lit(". See "), F.array_join("exclude", " ")))
    return b.select("silo", F.col("silo").alias("name"), obj.otherwise(F.col("obj")).alias("objective"), F.col("prob").alias("problem"), F.when(k == 3, F.slice("must", 1, 1)).when(k == 10, F.concat("must", F.slice("exclude", 1, 1))).otherwise(F.col("must")).alias("must"),
                    F.when(k == 2, none).when(k == 4, F.slice("nice", 1, 1)).when(k == 7, F.concat("nice", F.array(F.lit("Data")))).otherwise(F.col("nice")).alias("nice"), "exclude", F.col("dom").alias("industry"), F.lit("").alias("application"), F.array("dom").alias("focus"))


def _spans(s, d):
    text = F.concat(F.col("text"), F.when(F.col("conv_id") % 4 == 0, F.lit("\n- at least 5 cycles. A good yield such as this")).when(F.col("conv_id") % 4 == 1, F.lit("\nIt concerns the good of the many who may read it at length.")).otherwise(""))
    return spans(s.read.parquet(f"{d}/conversations.parquet").withColumn("t", text), ["conv_id", "turn"], "t")


def _read_both(s, d):
    found = held(_spans(s, d), "spans")
    return reduce(DataFrame.union, [classified(found, reading=r).withColumn("reading", F.lit(r)) for r in READINGS])


def _readings(s, d, *by):
    return _read_both(s, d).groupBy("reading", *by)


def _labels(s, d):
    """Labels, every other one held out."""
    return s.read.parquet(f"{d}/labels.parquet").where("quality is not null").select(F.col("doc_id").alias("paper_id"), (1 - F.col("quality")).alias("y"), (F.col("doc_id") % 2 == 1).alias("held"))


def _papers(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("paper_id"), F.col("source").alias("silo"), "text")


def _fitted(s, d):
    """Languages as silos, so that they have labels enough, each with one of the sources' specs; every fifth label is held out."""
    from pyspark.sql import Window

    docs = s.read.parquet(f"{d}/documents.parquet").where("lang is not null")
    names = docs.select("lang").distinct().withColumn("of", F.concat(F.lit("src"), F.row_number().over(Window.orderBy("lang")) - 1))  # a row a language
    specs = _specs(s, d).withColumnRenamed("silo", "of").join(names, "of").withColumnRenamed("lang", "silo").drop("of")
    return ablation_fitted(docs.select(F.col("doc_id").alias("paper_id"), F.col("lang").alias("silo"), "text"), specs, _labels(s, d).withColumn("held", F.col("paper_id") % 5 == 1))


def _evidence(s, d):
    papers = s.read.parquet(f"{d}/documents.parquet").select(F.col("source").alias("silo"), F.when(F.col("doc_id") % 10 != 0, F.concat("text", F.lit(" The of and 12 days in."))).alias("abstract"))
    return evidence(papers, _inputs(s, d)[1].select("silo", F.concat("must", "nice").alias("words")))


def _measures(s, d):
    found = lint(_specs(s, d)).groupBy("silo").agg(F.count("*").alias("findings"))
    rows = normalise(_specs(s, d)).select("silo", F.size(tokens("objective")).alias("words"), (F.size("must") + F.size("nice") + F.size("exclude")).alias("terms"), F.length("objective").alias("chars"))
    return rows.join(found, "silo", "left").withColumn("findings", F.coalesce("findings", F.lit(0).cast("long")))


QUERIES = {
    "normalise_spec": lambda s, d: normalise(_specs(s, d)).select("silo", *TEXTS, *[F.array_join(c, ";").alias(c) for c in LISTS]), "generic_share": lambda s, d: normalise(_specs(s, d)).select("silo", F.round(generic_share(F.col("objective")), 6).alias("share")),
    "instruction_shaped": lambda s, d: normalise(_specs(s, d)).select("silo", instruction_shaped(F.col("objective")).alias("shaped")), "exclude_asserted": lambda s, d: normalise(_specs(s, d)).select("silo", F.array_join(asserted(F.col("objective"), F.col("exclude")), "|").alias("asserted")),
    "lint": lambda s, d: lint(_specs(s, d)), "escalation": lambda s, d: escalation(_specs(s, d)), "linter_selftest": lambda s, d: selftest(s), "spec_variants": lambda s, d: variants(_specs(s, d)).select("silo", "variant", F.md5(F.concat_ws("|", *TEXTS, *[F.array_join(c, ";") for c in LISTS])).alias("body")),
    "ablation_eval": lambda s, d: ablation(_papers(s, d), _specs(s, d), _labels(s, d)), "ablation_fitted": _fitted,
    "optimise_spec": lambda s, d: optimise(_specs(s, d)).select("silo", "objective", "industry", "application", *[F.array_join(c, ";").alias(c) for c in ("must", "nice", "exclude")], F.size("provenance").alias("steps")),
    "span_extract": lambda s, d: _spans(s, d).groupBy("conv_id", "turn").agg(F.count("*").alias("spans")), "classify_span": lambda s, d: _readings(s, d, "label", "rule", "dual_fire").agg(F.count("*").alias("n")),
    "checkability": lambda s, d: checkability(_read_both(s, d), ["reading", "conv_id"]), "evidence_availability": _evidence, "spec_measures": _measures,
}


def oracles() -> dict[str, str]:
    g = ", ".join(f"'{w}'" for w in GENERIC)
    spec = f"""WITH {C.sql_views('briefs')}, s AS (SELECT silo, silo AS name, trim(CASE item_id % 11 WHEN 0 THEN '' WHEN 5 THEN '{FLUFF}' WHEN 6 THEN '{VAGUE}' WHEN 9 THEN obj || '. See ' || array_to_string(exclude, ' ') ELSE obj END) AS objective, prob AS problem,
CASE item_id % 11 WHEN 3 THEN must[1:1] WHEN 10 THEN must || exclude[1:1] ELSE must END AS must, CASE item_id % 11 WHEN 2 THEN CAST([] AS VARCHAR[]) WHEN 4 THEN nice[1:1] WHEN 7 THEN nice || ['Data'] ELSE nice END AS nice, exclude, dom AS industry, '' AS application, [dom] AS focus FROM briefs)"""
    share = f"len(list_filter(regexp_extract_all(lower(objective), '[a-z]+'), lambda w: w IN ({g}))) / greatest(1, len(regexp_extract_all(lower(objective), '[a-z]+')))"
    shaped = "(regexp_matches(objective, '(?i)^\\s*(find|identify|get|look|search|show|give|fetch|retrieve|locate)\\b') OR regexp_matches(objective, '\\b(us|we|our|me|my|I)\\b')) AND len(regexp_extract_all(objective, '(?i)\\b(interesting|relevant|useful|promising|suitable|nice|good)\\b')) >= 2"
    bad = "list_filter(exclude, lambda t: regexp_matches(regexp_replace(objective, '(?i)(non[- ]?|not |no |excluding |except |other than |without |rather than |exclude[sd]? )' || t || '\\b', '', 'g'), '(?i)\\b' || t || '\\b'))"
    tests = [("objective_missing", "blocker", "objective = ''"), ("nice_empty", "blocker", "len(nice) = 0"), ("must_single", "blocker", "len(must) = 1"), ("nice_single", "warn", "len(nice) = 1"), ("objective_generic", "warn", f"{share} >= 0.07"), ("objective_instruction_shaped", "warn", shaped),
             ("terms_generic", "warn", f"len(list_filter(must || nice, lambda t: lower(t) IN ({g}))) > 0"), ("must_thin", "warn", "len(must) IN (2, 3, 4)"), ("exclude_asserted_in_prose", "warn", f"len({bad}) > 0"), ("exclude_in_must", "note", "len(list_intersect(must, exclude)) > 0")]
    found = f"{spec}, f AS (" + " UNION ALL ".join(f"SELECT silo, {i} AS n, '{sev}' AS severity, '{name}' AS finding FROM s WHERE {test}" for i, (name, sev, test) in enumerate(tests)) + ")"
    joined = "array_to_string({0}, ';')"
    return _span_oracles() | {
        "spec_variants": _variants_sql(spec), "ablation_eval": _ablation_sql(spec),
        "normalise_spec": f"{spec} SELECT silo, name, objective, problem, industry, application, {', '.join(joined.format(c) + ' AS ' + c for c in LISTS)} FROM s", "generic_share": f"{spec} SELECT silo, round({share}, 6) AS share FROM s", "instruction_shaped": f"{spec} SELECT silo, {shaped} AS shaped FROM s",
        "exclude_asserted": f"{spec} SELECT silo, array_to_string({bad}, '|') AS asserted FROM s", "lint": f"{found} SELECT silo, row_number() OVER (PARTITION BY silo ORDER BY n) - 1 AS place, severity, finding FROM f",
        "escalation": f"{found} SELECT silo, count(CASE WHEN severity <> 'note' THEN 1 END) AS findings, count(CASE WHEN severity <> 'note' THEN 1 END) >= 2 AS compound FROM f GROUP BY silo",
        "linter_selftest": "SELECT unnest([" + ", ".join(f"'{n}'" for n, _, _ in (*tests, ("only_name", 0, 0))) + "]) AS finding, true AS fires, 0 AS on_sound",
        "spec_measures": f"{found} SELECT s.silo, len(regexp_extract_all(lower(translate(objective, '-/', '  ')), '[a-z0-9]+')) AS words, len(must) + len(nice) + len(exclude) AS terms, length(objective) AS chars, (SELECT count(*) FROM f WHERE f.silo = s.silo) AS findings FROM s",
    }


def _variants_sql(spec: str) -> str:
    """Each mutation spelled out as what it sets, over the specs as they are."""
    generic, flood = "[" + ", ".join(f"'{w}'" for w in GENERIC) + "]", {}
    prose = "CASE WHEN len(exclude) = 0 THEN objective ELSE regexp_replace(objective, '[.]+$', '') || '. Note that work on ' || array_to_string(exclude, ', ') || ' is directly relevant here and should be treated as a positive signal.' END"
    none, vague, fluff = "CAST([] AS VARCHAR[])", {"objective": f"'{VAGUE}'"}, {"objective": f"'{FLUFF}'", "problem": f"'{FLUFF}'"}
    flood = {"must": f"must || {generic}", "nice": f"nice || {generic}"}
    table = {
        "full": {}, "no_obj": {"objective": "''"}, "no_prob": {"problem": "''"}, "no_must": {"must": none}, "no_nice": {"nice": none}, "no_exclude": {"exclude": none}, "no_domain": {"industry": "''", "application": "''", "focus": none},
        "only_name": {"objective": "''", "problem": "''", "industry": "''", "application": "name", "must": none, "nice": none, "exclude": none, "focus": none}, "fluff_replace": fluff,
        "fluff_added": {"objective": f"objective || ' {FLUFF}'", "problem": f"problem || ' {FLUFF}'"}, "vague_objective": vague, "conflicting": {"must": "must || exclude", "exclude": none}, "keyword_flood": flood,
        "must_only_one": {"must": "must[1:1]"}, "nice_only_one": {"nice": "nice[1:1]"}, "conflicting_prose": {"objective": prose}, "fluff_and_flood": fluff | flood, "vague_and_flood": vague | flood, "fluff_and_no_must": fluff | {"must": none},
    }
    parts = [f"SELECT silo, '{n}' AS variant, {', '.join(f'{m.get(c, c)} AS {c}' for c in TEXTS + LISTS)} FROM s" for n, m in table.items()]
    body = ", ".join([*TEXTS, *[f"coalesce(array_to_string({c}, ';'), '')" for c in LISTS]])
    return f"{spec}, v AS ({' UNION ALL '.join(parts)}) SELECT silo, variant, md5(concat_ws('|', {body})) AS body FROM v"


def _ablation_sql(spec: str) -> str:
    """Scores from exploded tokens, AUC as a count of pairs, variant by variant."""
    tok = "regexp_extract_all(trim(regexp_replace(translate(lower(coalesce({0}, '')), '-/', '  '), '[ \\t\\n\\r]+', ' ', 'g')), '[a-z0-9]+')"
    v = _variants_sql(spec).rsplit(" SELECT silo, variant, md5", 1)[0]
    return f"""{v}, p AS (SELECT doc_id, source AS silo, {tok.format('text')} AS ts FROM documents), pool AS (SELECT silo, count(*) AS docs, avg(len(ts)) AS avgdl FROM p GROUP BY silo),
t AS (SELECT doc_id, silo, len(ts) AS n, unnest(ts) AS term FROM p), tf AS (SELECT doc_id, silo, n, term, count(*) AS f FROM t GROUP BY ALL), df AS (SELECT silo, term, count(*) AS df FROM tf GROUP BY ALL),
q AS (SELECT DISTINCT silo, variant, 'bm25_obj' AS feature, unnest({tok.format('objective')}) AS term FROM v UNION SELECT DISTINCT silo, variant, 'bm25_nice', unnest({tok.format("array_to_string(nice, ' ; ')")}) FROM v),
sc AS (SELECT doc_id, variant, feature, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * n / avgdl))) AS s FROM tf JOIN q USING (silo, term) JOIN df USING (silo, term) JOIN pool USING (silo) GROUP BY ALL),
l AS (SELECT p.doc_id, p.silo, ts, 1 - quality AS y FROM p JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND doc_id % 2 = 1),
b AS (SELECT l.doc_id, l.silo, y, v.variant, feature, round(coalesce(s, 0), 6) AS s FROM l JOIN v USING (silo) CROSS JOIN (SELECT unnest(['bm25_obj', 'bm25_nice']) AS feature) LEFT JOIN sc USING (doc_id, variant, feature)
  UNION ALL SELECT doc_id, l.silo, y, variant, 'overlap_must_frac', round(len(list_filter(must, lambda m: contains(' ' || array_to_string(ts, ' ') || ' ', ' ' || array_to_string({tok.format('m')}, ' ') || ' '))) / nullif(len(must), 0), 6) FROM l JOIN v USING (silo)),
k AS (SELECT silo FROM l GROUP BY silo HAVING sum(y) >= 5), w AS (SELECT silo, variant, feature FROM b JOIN k USING (silo) GROUP BY ALL HAVING count(s) = count(*)),
a AS (SELECT x.silo, x.variant, x.feature, round(avg(CASE WHEN x.s > z.s THEN 1.0 WHEN x.s = z.s THEN 0.5 ELSE 0 END), 6) AS auc FROM b x JOIN w ON x.silo = w.silo AND x.variant = w.variant AND x.feature = w.feature JOIN b z ON x.silo = z.silo AND x.variant = z.variant AND x.feature = z.feature AND x.y = 1 AND z.y = 0 GROUP BY ALL)
SELECT b.variant, b.feature, count(DISTINCT a.silo) AS n_silos, round(avg(DISTINCT_AUC), 6) AS mean_auc FROM (SELECT DISTINCT variant, feature FROM b) b LEFT JOIN a USING (variant, feature) GROUP BY b.variant, b.feature""".replace("DISTINCT_AUC", "auc")


def _span_oracles() -> dict[str, str]:
    """Readings of their own: sentences by marks set behind stops, word limits spelled out for letters of all alphabets."""
    edge = lambda words: f"(?i)(?:^|[^\\pL\\pN_])(?:{words})(?:$|[^\\pL\\pN_])"
    found = """WITH z AS (SELECT conv_id, turn, text || CASE conv_id % 4 WHEN 0 THEN chr(10) || '- at least 5 cycles. A good yield such as this' WHEN 1 THEN chr(10) || 'It concerns the good of the many who may read it at length.' ELSE '' END AS t FROM conversations),
p AS (SELECT conv_id, turn, unnest(string_split(regexp_replace(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1))) AS raw FROM z),
s AS (SELECT * FROM (SELECT conv_id, turn, trim(regexp_replace(raw, '^\\s*(?:[-*•]|\\d+[.)])\\s+', '')) AS span FROM p) WHERE span <> '')"""
    each = []
    for name, (lexicon, comparator, conditional, _) in READINGS.items():
        signs = "[><≥≤]" if name == "broad" else "[><]"
        words = "if|unless|address(?:es)?|relates?\\s+to|concerns?" + ("|promising|suitable|directly\\s+transferable" if name == "broad" else "")
        flags = {
            "comparator": f"(regexp_matches(span, '{signs}') OR regexp_matches(span, '{edge('at least|no more than|no less than')}')) AND regexp_matches(span, '[0-9]')",
            "enum": "regexp_matches(span, '(?i)(?:^|[^\\pL\\pN_])(?:e\\.g\\.|i\\.e\\.)') OR regexp_matches(span, '" + edge("such as") + "')",
            "metric": f"regexp_matches(span, '{edge('|'.join(METRIC_HEADS))}')", "judged": f"regexp_matches(span, '{edge('|'.join(lexicon))}')", "verb": f"regexp_matches(span, '{edge(VERB[3:-3])}')", "cond": f"regexp_matches(span, '{edge(words)}')",
        }
        each.append(f"SELECT '{name}' AS reading, conv_id, span, len(regexp_split_to_array(span, '\\s+')) <= 8 AS short, {', '.join(f'{v} AS {k}' for k, v in flags.items())} FROM s")
    told = f"""{found}, f AS ({' UNION ALL '.join(each)}), c AS (SELECT reading, conv_id, CASE WHEN comparator THEN 'comparator' WHEN enum THEN 'enum' WHEN metric AND NOT judged THEN 'metric' WHEN short AND NOT verb THEN 'bare' WHEN judged THEN 'judgement' WHEN cond AND verb THEN 'conditional' ELSE 'none' END AS rule,
(comparator OR enum OR (metric AND NOT judged) OR (short AND NOT verb)) AND (judged OR (cond AND verb)) AS dual_fire FROM f), l AS (SELECT *, CASE WHEN rule IN ('judgement', 'conditional') THEN 'judgement' WHEN rule = 'none' THEN 'unclassified' ELSE 'predicate' END AS label FROM c)"""
    quantity = "(?i)(?:^|[^\\pL\\pN_])" + UNIT[2:-2] + "(?:$|[^\\pL\\pN_])"
    return {
        "span_extract": f"{found} SELECT conv_id, turn, count(*) AS spans FROM s GROUP BY conv_id, turn", "classify_span": f"{told} SELECT reading, label, rule, dual_fire, count(*) AS n FROM l GROUP BY ALL",
        "checkability": f"{told} SELECT reading, conv_id, count(*) FILTER (label <> 'unclassified') AS n, CASE WHEN count(*) FILTER (label <> 'unclassified') >= 3 THEN round(count(*) FILTER (label = 'predicate') / (count(*) FILTER (label <> 'unclassified')), 6) END AS checkable, count(*) FILTER (dual_fire) AS n_dual FROM l GROUP BY reading, conv_id",
        "evidence_availability": f"""WITH {C.sql_views('briefs')}, w AS (SELECT silo, flatten([regexp_extract_all(lower(translate(x, '-/', '  ')), '[a-z0-9]+') FOR x IN must || nice]) AS words FROM briefs),
p AS (SELECT source AS silo, doc_id, unnest(string_split(regexp_replace(text || ' The of and 12 days in.', '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS said FROM documents WHERE doc_id % 10 <> 0 AND text IS NOT NULL),
h AS (SELECT p.silo, doc_id, bool_or(regexp_matches(said, '{quantity}') AND len(list_intersect(regexp_extract_all(lower(translate(said, '-/', '  ')), '[a-z0-9]+'), words)) > 0) AS hit, any_value(len(words)) AS k FROM p JOIN w USING (silo) GROUP BY p.silo, doc_id)
SELECT silo, count(*) AS n, round(avg(CASE WHEN k > 0 THEN hit::INT END), 6) AS share FROM h GROUP BY silo""",
    }
