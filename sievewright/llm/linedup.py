"""Line dedup by a suffix array over line ids.

Lines (cut at \\n) that hold a solid character get ids, equal lines the same; the sequence of a
document's ids is one string of the collection. Prefix doubling ranks the suffixes: ranks of the 2^k lines from
a position on and from 2^k further give, sorted as pairs by range partitions, ranks of 2^(k+1) lines.
Suffixes alone in their rank are sorted for good and leave, which ends the rounds once no run repeats.

The ranks of all rounds then give the longest-common-prefix intervals, as a trie walked from the longest
power of two to the shortest: suffixes that share the next 2^k lines go down to a child interval, whose first member in
(doc_id, text hash, line) order also stays above for the others. The length at which a suffix was last not the first of
its interval is the longest run from it on that an earlier place has too. Runs that no longer run covers
are maximal; every maximal run of ``MIN_LINES`` lines or more that is a later copy loses its lines.

Blank lines are neither copies nor breaks: they stay. Null and empty texts stay as they are; rows with a null
doc_id are kept as they are and are no source; rows that repeat a doc_id are ordered by a hash of
their text, and equal rows count once and are equal in result; an empty table gives no rows; texts of any number of lines
are read whole, a line at a time once split; other columns are kept by ``dedup_text``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh

MIN_LINES = 2
# The joins below are sort-merge joins at every size: both sides grow with the input, and AQE splits their skewed partitions.


def lines(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, tk (a hash of the text), pos (among the solid lines), h (128-bit hash) of every solid line of the distinct rows."""
    text = F.col("text")
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), F.monotonically_increasing_id().alias("row"), _solid(text).alias("ls"))
    each = rows.select("doc_id", "tk", "row", F.posexplode("ls").alias("pos", "x")).select("doc_id", "tk", "row", "pos", F.md5(F.col("x").cast("binary")).alias("h"))
    each = scratch.save(each, "lines")
    # of rows that repeat, one counts
    twice = each.where("pos = 0").groupBy("doc_id", "tk").agg(F.min("row").alias("one"), F.count("*").alias("n")).where("n > 1").select("doc_id", "tk", "one")
    return each.join(twice, ["doc_id", "tk"], "left").where("one is null or row = one").select("doc_id", "tk", "pos", "h")


def _is_solid(line):
    return F.rtrim(F.ltrim(F.translate(line, "\t\r\x0b\x0c", "    "))) != ""


def _solid(text):
    return F.filter(F.split(text, "\n"), _is_solid)


def _ranked(rows: DataFrame, key: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Rows whose key is shared, with its order-preserving rank."""
    shared = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    # distinct keys in order: the id of a row in range-sorted partitions rises with its key
    order = shared.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("rank", F.monotonically_increasing_id())
    order = scratch.save(order.select(*key, "rank"), f"{name}-rank")
    out = scratch.save(rows.join(order.hint("merge"), key).select("doc_id", "tk", "pos", "rank"), name)
    scratch.drop(f"{name}-rank")
    return out


def suffix_ranks(docs: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """For k = 0, 1, ...: doc_id, tk, pos, rank of the suffixes whose first 2^k lines occur elsewhere, until none do."""
    levels, size = [_ranked(lines(docs, scratch), ["h"], scratch, "level0")], 1
    while levels[-1].take(1):
        level = levels[-1]
        further = level.select("doc_id", "tk", (F.col("pos") - size).alias("pos"), F.col("rank").alias("r2")).where("pos >= 0")
        pairs = level.withColumnRenamed("rank", "r1").join(further.hint("merge"), ["doc_id", "tk", "pos"])
        levels.append(_ranked(pairs, ["r1", "r2"], scratch, f"level{len(levels)}"))
        size *= 2
    return levels[:-1]


def earlier_lengths(levels: list[DataFrame], scratch: Scratch, least: int) -> DataFrame | None:
    """doc_id, tk, pos, size: the most lines (``least`` or more) from a place on that an earlier place has too; None where no run is as long."""
    base = max(0, least.bit_length() - 1)  # runs of ``least`` lines share 2^base
    if base >= len(levels):
        return None
    at = ["doc_id", "tk", "pos"]
    # node and len name an interval: len lines are shared, node tells intervals of one len apart; copy: lines shared with an earlier suffix
    rows = levels[base].select(*at, F.lit(0).cast("long").alias("node"), F.lit(0).alias("len"), F.lit(0).alias("copy"))
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        ranks = levels[k].select("doc_id", "tk", (F.col("pos")).alias("to"), "rank")
        placed = scratch.save(rows.withColumn("to", F.col("pos") + F.col("len")).join(ranks.hint("merge"), ["doc_id", "tk", "to"], "left").drop("to"), f"placed{k}")
        child = placed.where("rank is not null").groupBy("len", "node", "rank").agg(F.count("*").alias("n"), F.min(F.struct(*at)).alias("first")).where("n > 1")
        child = scratch.save(child.withColumn("child", F.monotonically_increasing_id()), f"child{k}")
        found = placed.join(child.select("len", "node", "rank", "child", "first").hint("merge"), ["len", "node", "rank"], "left")
        later = F.struct(*at) != F.col("first")
        down = F.struct(F.col("child").alias("node"), (F.col("len") + step).alias("len"), F.when(later, F.col("len") + step).otherwise(0).alias("copy"))
        stay = F.struct("node", "len", "copy")
        # a copy goes down; the first of a child goes down and stays; a suffix without a child stays
        rows = found.select(*at, F.explode(F.when(F.col("child").isNull(), F.array(stay)).when(later, F.array(down)).otherwise(F.array(stay, down))).alias("i")).select(*at, "i.*")
        rows = scratch.save(rows, f"rows{k}")
        for name in (f"placed{k}", f"child{k}", f"rows{k + 1}"):
            scratch.drop(name)
    return rows.where(F.col("copy") >= least).groupBy(*at).agg(F.max("copy").alias("size"))


def copied_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """doc_id, tk, runs (pos, size): the maximal runs of ``min_lines`` solid lines or more that an earlier place has too."""
    scratch = Scratch(docs.sparkSession, "linedup")
    found = earlier_lengths(suffix_ranks(docs, scratch), scratch, min_lines)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, tk long, runs array<struct<pos: int, size: int>>")
    # a place whose run ends with that of the place before it is covered by it
    before = F.lag(F.struct("pos", "size")).over(Window.partitionBy("doc_id", "tk").orderBy("pos"))
    covered = (before["pos"] == F.col("pos") - 1) & (before["size"] > F.col("size"))
    runs = found.withColumn("covered", F.coalesce(covered, F.lit(False))).where("not covered")
    return scratch.save(runs.groupBy("doc_id", "tk").agg(F.sort_array(F.collect_list(F.struct("pos", "size"))).alias("runs")), "runs")


def _cut(text: pd.Series, starts: pd.Series, sizes: pd.Series) -> pd.DataFrame:
    """Texts less the solid lines of their runs, and how many those are; nulls for texts without runs."""
    kept, removed = [], []
    for t, a, n in zip(text, starts, sizes, strict=True):
        if t is None or a is None:
            kept.append(None), removed.append(0)
            continue
        mark = np.zeros(int((a + n).max()) + 1, np.int64)
        np.add.at(mark, a, 1)
        np.subtract.at(mark, a + n, 1)
        gone, nth, out = (np.cumsum(mark) > 0).tolist(), -1, []
        for line in t.split("\n"):
            if line.strip(" \t\r\x0b\x0c"):
                nth += 1
                if nth < len(gone) and gone[nth]:
                    continue
            out.append(line)
        kept.append("\n".join(out)), removed.append(sum(gone))
    return pd.DataFrame({"kept": kept, "removed": removed})


def _with_cuts(docs: DataFrame, min_lines: int, cut: str, run: str) -> DataFrame:
    """``docs`` with ``cut`` (struct of kept text, null where nothing goes, and removed lines) and ``run`` (lines of the longest maximal run)."""
    at, key, mine, runs = fresh(docs, "_id", "_tk", "_mine", "_runs")
    found = copied_runs(docs, min_lines).select(F.col("doc_id").alias(at), F.col("tk").alias(key), F.col("runs").alias(runs))
    out = docs.withColumn(mine, F.xxhash64("text")).join(found.hint("merge"), (F.col("doc_id") == F.col(at)) & (F.col(mine) == F.col(key)), "left")
    some = F.when(F.col(runs).isNotNull(), F.col("text"))
    cutter = F.pandas_udf(_cut, "kept string, removed long")
    out = out.withColumn(cut, cutter(some, F.col(f"{runs}.pos"), F.col(f"{runs}.size")))
    return out.withColumn(run, F.coalesce(F.array_max(F.col(f"{runs}.size")), F.lit(0)).cast("long")).drop(at, key, mine, runs)


def dedup_text(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """``docs`` without the lines of later copies of runs."""
    cut, run = fresh(docs, "_cut", "_run")
    out = _with_cuts(docs, min_lines, cut, run)
    return out.withColumn("text", F.coalesce(F.col(f"{cut}.kept"), F.col("text"))).drop(cut, run)


def dedup_digest(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """doc_id, n_removed (lines), longest_run (lines of the longest copied run that starts here), kept_sha256 (null text: as empty) for every row."""
    out = _with_cuts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), min_lines, "cut", "run")
    kept = F.coalesce(F.col("cut.kept"), F.col("text"), F.lit(""))
    return out.select("doc_id", F.col("cut.removed").alias("n_removed"), F.col("run").alias("longest_run"), F.sha2(kept, 256).alias("kept_sha256"))
