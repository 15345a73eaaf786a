"""Ranks, samples and folds by a row's place in its silo, found over ranges of values: no silo's rows meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.catalogue import CATALOGUE as C
from .evaluation import places, running_counts, share_ranks, tied_auc

#: Negatives that a case-control sample keeps of a silo.
CONTROLS = 30


def drawn(key: str, seed: int = 42) -> list:
    """An order by chance that hangs on the key alone."""
    return [F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string"))), key]


def percent_rank(rows: DataFrame, by: str, key: str, value: str) -> DataFrame:
    """key, pr: average-tie share of rank among the group's values; null where there is none."""
    return share_ranks(rows.select(key, by, value), by, key, [value]).select(key, F.round(f"rank_{value}", 6).alias("pr"))


def ordinal_rank(rows: DataFrame, by: str, key: str, value: str) -> DataFrame:
    """key, pr: rows before by value, then key, over the others; null in a group of one."""
    return places(rows, [by], [value, key]).select(key, F.round(F.col("before") / F.nullif(F.col("total") - 1, F.lit(0)), 6).alias("pr"))


def case_control(rows: DataFrame, controls: int = CONTROLS, seed: int = 42) -> DataFrame:
    """paper_id, silo, y, w: all positives and up to ``controls`` drawn negatives of each silo, weighed by what they stand for."""
    placed = places(rows.select("paper_id", "silo", "y"), ["silo", "y"], drawn("paper_id", seed))
    weight = F.when(F.col("y") == 1, 1.0).otherwise(F.round(F.col("total") / F.least(F.col("total"), F.lit(controls)), 6))
    return placed.where((F.col("y") == 1) | (F.col("before") < controls)).select("paper_id", "silo", "y", weight.alias("w"))


def class_deal(rows: DataFrame, most: int = 5) -> DataFrame:
    """paper_id, fold: each class of a silo dealt round in order of id to k = min(``most``, positives, negatives) folds; null where k is below two."""
    sizes = rows.groupBy("silo").agg(F.least(F.lit(most), F.sum("y"), F.count("*") - F.sum("y")).alias("k"))
    placed = places(rows.select("paper_id", "silo", "y"), ["silo", "y"], ["paper_id"]).join(sizes, "silo")
    return placed.select("paper_id", F.when(F.col("k") >= 2, F.col("before") % F.col("k")).alias("fold"))


def per_stratum(rows: DataFrame, stratum: str, key: str, n: int = 25, seed: int = 42) -> DataFrame:
    """key and stratum of ``n`` drawn rows of each stratum."""
    return places(rows.select(key, stratum), [stratum], drawn(key, seed)).where(F.col("before") < n).select(key, stratum)


def stratified_share(rows: DataFrame, share: float = 0.1, seed: int = 42) -> DataFrame:
    """paper_id, silo, y: a drawn ``share`` of each silo's class, half to even, one row at least."""
    placed = places(rows.select("paper_id", "silo", "y"), ["silo", "y"], drawn("paper_id", seed))
    return placed.where(F.col("before") < F.greatest(F.lit(1), F.bround(F.col("total") * share))).select("paper_id", "silo", "y")


def few_shots(rows: DataFrame, n: int = 2, folds: int = 5, seed: int = 7) -> DataFrame:
    """fold, paper_id, silo, y: for every fold ``n`` drawn examples of each silo's class from the other folds (a row's fold is its id modulo ``folds``)."""
    others = rows.select("paper_id", "silo", "y", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold")).where(F.col("paper_id") % folds != F.col("fold"))
    return places(others, ["fold", "silo", "y"], drawn("paper_id", seed)).where(F.col("before") < n).select("fold", "paper_id", "silo", "y")


def negatives(rows: DataFrame, n: int = 10) -> DataFrame:
    """paper_id, silo, policy: a silo's ``n`` highest (hard), lowest (easy), half of each (mixed) and drawn (random) negatives by score."""
    rows = rows.where("y = 0").select("paper_id", "silo", "s")
    rows = places(rows, ["silo"], [F.col("s").isNull(), -F.col("s"), "paper_id"], "hard", "_n").drop("_n")
    rows = places(rows, ["silo"], ["s", "paper_id"], "easy", "_n").drop("_n")
    rows = places(rows, ["silo"], drawn("paper_id"), "random", "_n")
    first = {"hard": F.col("hard") < n, "easy": F.col("easy") < n, "mixed": (F.col("hard") < n // 2) | (F.col("easy") < n // 2), "random": F.col("random") < n}
    names = F.filter(F.array(*[F.when(at, F.lit(k)) for k, at in first.items()]), lambda x: x.isNotNull())
    return rows.select("paper_id", "silo", F.explode(names).alias("policy"))


def gate(rows: DataFrame, controls: int = CONTROLS, auc: float = 0.03, prevalence: float = 0.005) -> DataFrame:
    """silo, AUC and prevalence of all rows and of the weighted case-control sample, and whether both are near enough."""
    sample = case_control(rows, controls).join(rows.select("paper_id", "s"), "paper_id")
    cells = sample.groupBy("silo", "s").agg(F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("y") == 0, F.col("w")).otherwise(0.0)).alias("q"))
    cells = running_counts(cells, ["silo"], "s", "q")
    of_sample = cells.groupBy("silo").agg((F.sum(F.col("p") * (F.col("before") + F.col("q") / 2)) / F.nullif(F.sum("p") * F.sum("q"), F.lit(0.0))).alias("sample_auc"), (F.sum("p") / F.nullif(F.sum("p") + F.sum("q"), F.lit(0.0))).alias("sample_prevalence"))
    whole = tied_auc(rows, ["silo"], "s").select("silo", "auc", (F.col("n_pos") / F.col("n")).alias("prevalence"))
    both = whole.join(of_sample, "silo")
    passed = (F.abs(F.col("auc") - F.col("sample_auc")) < auc) & (F.abs(F.col("prevalence") - F.col("sample_prevalence")) < prevalence)
    return both.select("silo", "auc", F.round("sample_auc", 6).alias("sample_auc"), F.round("prevalence", 6).alias("prevalence"), F.round("sample_prevalence", 6).alias("sample_prevalence"), passed.alias("passed"))


def dealt_cards(cards: DataFrame, controls: DataFrame, first: int = 9, every: int = 7) -> DataFrame:
    """paper_id, silo, place, control: unlabelled cards by falling score, a labelled one (by rising score) at place ``first`` and every ``every`` places after, while cards last.

    cards, controls: paper_id, silo, score."""
    cards = places(cards, ["silo"], [-F.col("score"), "paper_id"]).withColumn("k", F.col("before") + 1)
    shift = F.when(F.col("k") >= first, F.floor((F.col("k") - first) / (every - 1)) + 1).otherwise(0)
    dealt = cards.select("paper_id", "silo", (F.col("k") + shift).cast("long").alias("place"), F.lit(False).alias("control"))
    most = cards.groupBy("silo").agg(F.count("*").alias("cards"))
    known = places(controls, ["silo"], ["score", "paper_id"]).join(most, "silo").where((first - 1) + (every - 1) * F.col("before") < F.col("cards"))
    return dealt.union(known.select("paper_id", "silo", (first + every * F.col("before")).cast("long"), F.lit(True)))


def _deal(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("paper_id"), F.col("lang").alias("silo"), (F.col("n_chars") % 97).alias("score"))
    known = s.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("paper_id"))
    return dealt_cards(docs.join(known, "paper_id", "left_anti"), docs.join(known, "paper_id", "left_semi"))


def _scored(s, d):
    return C.view_frame(s, "scored", lambda t: s.read.parquet(f"{d}/{t}.parquet"))


QUERIES = {
    "pct_rank": lambda s, d: percent_rank(_scored(s, d), "silo", "paper_id", "s"), "pct_rank_ordinal": lambda s, d: ordinal_rank(_scored(s, d), "silo", "paper_id", "s"),
    "case_control_sample": lambda s, d: case_control(_scored(s, d)), "stratified_kfold": lambda s, d: class_deal(_scored(s, d)),
    "proportional_stratified_subsample": lambda s, d: stratified_share(_scored(s, d)), "few_shot_select": lambda s, d: few_shots(_scored(s, d)), "negative_policy": lambda s, d: negatives(_scored(s, d)),
    "sampling_gate": lambda s, d: gate(_scored(s, d)), "deal_batch": _deal,
    "sample_per_stratum": lambda s, d: per_stratum(s.read.parquet(f"{d}/documents.parquet"), "lang", "doc_id"),
}
