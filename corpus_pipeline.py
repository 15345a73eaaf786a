"""A training-data pipeline over ``documents``: each stage is one corpus operator.

Null and empty texts are scored like any other and, where kept, pass all stages (blank ones are near copies of each other; a row without an id is kept by every
stage that compares documents); repeated rows fall to one in the near-dedup stage; an empty table gives no rows; further columns of ``documents`` go along, whatever
their names, up to the packing, which returns pieces; ties are settled by doc_id, then by hashes of the texts; texts are read whole by every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievewright.llm import linedup, nbsvm, packing, recompression, simhash
from sievewright.llm.common import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels of the documents at hand."""
    return nbsvm.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(linedup.dedup_text(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_representatives(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(recompression.dedup_text(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    from pyspark.sql import functions as F

    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [("quality", quality), ("line dedup", line_dedup), ("near dedup", near_dedup), ("substring dedup", substring_dedup), ("packing", pack)]

#: Hashed models, fingerprints and tokenizer ids are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), str(i))
        if i:
            scratch.drop(str(i - 1))
    return docs
