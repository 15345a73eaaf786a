r"""Mixing sources to target weights by capped water-filling, with DataFrame functions alone.

A document's size is its number of words ``[^\x20\x09-\x0D]+``. The sources' targets share a total by weight; a target never exceeds
``max_epochs`` times its source's size, and what is cut off there goes to the others by weight, until no target is above. A round is one
aggregate over the sources: those whose cap lies below the common level are clamped, the level rises, and it ends when no more are; clamped
sources stay clamped, so the rounds are as many as levels that clamp something. Comparisons are exact, in integers.

A source takes all its documents as often as whole epochs fit its target, and of one more pass the documents that come first in a seeded order
(a digest of seed, doc_id and text), up to the last word of the target; the document where the target ends gives its first words only. So a source's
words equal its rounded target. The words before a document in that order are summed by levels of the digest's digits: at most 256 sums a
source and level; only the documents of the one bucket in which a target ends are sorted, so no source is in one task.

Null text: size 0; a null source is a source of its own and the last one; a null doc_id is an id like any other; sources of size 0 get
target 0; rows that repeat each other are documents of their own (which of them gives the last words cannot be told); ties of the digest are such
rows alone; texts are counted whole; other columns are ignored by ``shares`` and kept by ``sample``; an empty table gives no rows.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

WORD, WEIGHTS, MAX_EPOCHS, SEED = r"[^\x20\x09-\x0D]+", (1, 2, 3), 3, "mix"


def _exact(column) -> F.Column:
    return F.col(column).cast("decimal(28,0)")


def ranked_sources(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """``at`` from 0 for every row by source, null last: ranges are sorted for themselves and shifted by the rows of those before."""
    order = F.col("source").asc_nulls_last()
    dealt = scratch.save(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "ranges")
    ends = dealt.groupBy("part").agg(F.count("*").alias("n"))  # a row a partition
    ends = ends.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("shift"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return dealt.withColumn("inside", inside).join(ends, "part").withColumn("at", F.col("shift") + F.col("inside")).drop("part", "inside", "shift")


def water_fill(sources: DataFrame, total: int | None = None, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``target`` for every row of ``sources`` (source_size, weight): ``total`` (default: all sizes) by weight, capped, the excess shared again."""
    sums = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    total = int(sums[0] or 0) if total is None else total
    all_weight = int(sums[1] or 0)
    cap, left, weight = F.col("source_size") * max_epochs, total, all_weight

    def above():
        return (_exact("source_size") * max_epochs) * F.lit(Decimal(weight)) < _exact("weight") * F.lit(Decimal(left))

    while weight:
        clamped = sources.where(above()).agg(F.sum(cap), F.sum("weight")).first()
        now = total - int(clamped[0] or 0), all_weight - int(clamped[1] or 0)
        if now == (left, weight):
            break
        left, weight = now
    if not weight:
        return sources.withColumn("target", cap.cast("double"))
    return sources.withColumn("target", F.when(above(), cap.cast("double")).otherwise(F.col("weight").cast("double") * float(left) / float(weight)))


def _taken(docs: DataFrame, carried, weights: tuple[int, ...], max_epochs: int, seed: str) -> DataFrame:
    """``carried`` columns, source, size, source_size, target, taken of every document."""
    scratch = Scratch(docs.sparkSession, "mixing")
    text, key = F.coalesce("text", F.lit("")), "key"
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text)))
    sized = docs.select(*carried, F.col("source").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), digest.alias(key))
    sized = scratch.save(sized.withColumn("b8", F.substring(key, 1, 2)).withColumn("b16", F.substring(key, 1, 4)), "sized")
    fine = scratch.save(sized.groupBy("source", "b8", "b16").agg(F.sum("size").alias("words")), "fine")
    coarse = fine.groupBy("source", "b8").agg(F.sum("words").alias("words"))
    sources = fine.groupBy("source").agg(F.sum("words").alias("source_size"))
    ranked = ranked_sources(sources, scratch)
    dealt = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("at") % len(weights) + 1).cast("int")).cast("long")
    filled = scratch.save(water_fill(scratch.save(ranked.withColumn("weight", dealt), "weighted"), max_epochs=max_epochs), "filled")
    words = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target + 0.5) div source_size")).otherwise(F.lit(0).cast("long"))
    goals = filled.select(F.col("source").alias("of"), "source_size", "target", whole.alias("whole"), (words - whole * F.col("source_size")).alias("quota"))
    before = lambda by: F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    coarse = coarse.join(goals, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("before", before("b8"))
    ends_here = (F.col("before") < F.col("quota")) & (F.col("quota") < F.col("before") + F.col("words"))
    coarse = scratch.save(coarse.withColumn("cut", ends_here), "coarse")
    rows = sized.alias("d").join(coarse.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.b8") == F.col("c.b8")))
    mine, theirs = [F.col(f"d.{c}") for c in sized.columns], [F.col(f"c.{c}") for c in ("source_size", "target", "whole", "quota", "before", "cut")]
    rows = scratch.save(rows.select(*mine, *theirs), "rows")
    sure = rows.where(~F.col("cut")).withColumn("first", F.col("before"))
    # within the bucket where the target ends: the next digits' sums, then the documents of one bucket of those
    cut = coarse.where("cut").select(F.col("source").alias("of"), F.col("b8").alias("at8"), F.col("before").alias("base"))
    below = fine.join(cut, F.col("source").eqNullSafe(F.col("of")) & (F.col("b8") == F.col("at8")))
    below = below.select("of", "b16", (F.col("base") + F.coalesce(F.sum("words").over(Window.partitionBy("of").orderBy("b16").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("base"))
    edge = rows.where("cut").alias("d").join(below.alias("e"), F.col("d.source").eqNullSafe(F.col("e.of")) & (F.col("d.b16") == F.col("e.b16")))
    run = Window.partitionBy("source", "b16").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.select(*[F.col(f"d.{c}") for c in rows.columns], "base").withColumn("first", F.col("base") + F.coalesce(F.sum("size").over(run), F.lit(0))).drop("base")
    out = sure.unionByName(edge)
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - F.col("first")))
    return out.withColumn("taken", F.col("whole") * F.col("size") + last)


def shares(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target (its source's), taken (words the mix takes, repeats counted) of every row of ``docs`` (doc_id, text, source).

    Sources by code point weigh ``weights`` in turn, over again."""
    return _taken(docs, [F.col("doc_id").alias("doc_id")], weights, max_epochs, seed).select("doc_id", "size", "source_size", "target", "taken")


def sample(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: every column of ``docs`` once for each repetition, ``text`` cut to its first words (a space apart) where a source's target ends.
    One column more, ``epoch`` from 0 (``epoch_``, ... where that name is taken); documents of no words are left out."""
    from .common import fresh

    taken = _taken(docs, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("doc_id")], weights, max_epochs, seed)
    epoch = fresh(docs, "epoch")[0]
    turns = F.sequence(F.lit(0), F.expr("(taken - 1) div size"))
    each = taken.where("taken > 0").select("row", "size", "taken", F.explode(turns).alias("t"))
    length = F.least(F.col("size"), F.col("taken") - F.col("t") * F.col("size"))
    first = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(WORD), F.lit(0)), F.lit(1), length.cast("int")), " ")
    text = F.when(length == F.col("size"), F.col("row.text")).otherwise(first)
    return each.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns], F.col("t").cast("int").alias(epoch))
