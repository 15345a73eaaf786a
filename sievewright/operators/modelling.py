"""Models, resampling, folds and response parsing that SQL cannot state: Spark ML, or Arrow functions over groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import auc
from ..plans.held import held

FEATURES = ["log_chars", "n_words", "share_upper", "share_marks"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per labelled document with its lexical features, y = 1 for the rare class and a fold by title."""
    n = F.length("text") + 1
    return docs.join(labels, "doc_id").select(
        "doc_id", "lang", (1 - F.col("quality")).cast("double").alias("y"), F.log1p(F.length("text").cast("double")).alias("log_chars"), F.size(F.split("text", " ")).cast("double").alias("n_words"),
        (F.regexp_count("text", F.lit("[A-Z]")) / n).alias("share_upper"), (F.regexp_count("text", F.lit("[!%&$#*|]")) / n).alias("share_marks"), F.pmod(F.xxhash64(F.split_part("text", F.lit("\n"), F.lit(1))), F.lit(5)).cast("int").alias("fold"),
    )


def prepare_dataset(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled rows with y and their group: a text without a solid title is a group of its own."""
    title = F.trim(F.lower(F.split_part("text", F.lit("\n"), F.lit(1))))
    group = F.when(title == "", F.concat(F.lit("no_title_"), F.col("doc_id").cast("string"))).otherwise(title)
    return docs.join(labels.where("quality is not null"), "doc_id").select("doc_id", F.col("lang").alias("silo"), (1 - F.col("quality")).cast("int").alias("y"), F.md5(group).alias("grp"))


def balanced(rows: DataFrame) -> DataFrame:
    """Class weights n / (2 n_c) beside an assembled vector."""
    counts = rows.groupBy("y").agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("n"))
    weights = counts.crossJoin(total).select("y", (F.col("n") / (2 * F.col("c"))).alias("weight"))
    return VectorAssembler(inputCols=FEATURES, outputCol="x").transform(rows.join(F.broadcast(weights), "y"))


def fold_scores(rows: DataFrame, estimator, score, folds: int = 5) -> DataFrame:
    """Every row scored once, by the model fitted on the other folds."""
    out = None
    for fold in range(folds):
        part = estimator.fit(rows.where(F.col("fold") != fold)).transform(rows.where(F.col("fold") == fold)).select("doc_id", "lang", "y", score.alias("score"))
        out = part if out is None else out.union(part)
    return out


def platt_scores(rows: DataFrame, estimator, folds: int = 5) -> DataFrame:
    """Out-of-fold margins turned into probabilities by a logistic curve that is fitted on the other folds' margins."""
    margins = held(rows.select("doc_id", "fold").join(fold_scores(rows, estimator, _second("rawPrediction"), folds), "doc_id"), "margins")
    curve = VectorAssembler(inputCols=["score"], outputCol="x").transform(margins.withColumnRenamed("score", "margin").withColumnRenamed("margin", "score"))
    return fold_scores(curve, LogisticRegression(featuresCol="x", labelCol="y", regParam=1e-6), _second("probability"), folds)


def _rows(spark, sf_dir) -> DataFrame:
    return held(balanced(features(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))), "features")


def _model_query(make, column="probability"):
    return lambda spark, sf_dir: fold_scores(_rows(spark, sf_dir), make(), _second(column))


def _second(col: str):
    """The second entry of a vector column."""
    from pyspark.ml.functions import vector_to_array

    return F.element_at(vector_to_array(col), 2)


group_auc = auc


def pca_projection(vectors: DataFrame, k: int = 2) -> DataFrame:
    """Centred vectors on their first components; a component's largest loading is made positive."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.feature import StandardScaler

    rows = vectors.select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    rows = StandardScaler(withMean=True, withStd=False, inputCol="v", outputCol="c").fit(rows).transform(rows)
    model = PCA(k=k, inputCol="c", outputCol="p").fit(rows)
    load = model.pc.toArray()
    sign = [float(np.sign(load[np.abs(load[:, j]).argmax(), j])) for j in range(k)]
    p = vector_to_array("p")
    return model.transform(rows).select("vec_id", *[(p[j] * sign[j]).alias(f"pc{j + 1}") for j in range(k)])


def streaming_label_counts(spark, sf_dir):
    """An extension without a counterpart: hourly event counts as a stream with a watermark, run until its input is used up."""
    from ..streaming.counts import hourly_counts

    return hourly_counts(spark, f"{sf_dir}/events.parquet")


def label_stream(spark, sf_dir):
    """Every user's label by the stateful stream over all events, run until its input is used up: an event is a label, every seventh takes the last one back."""
    from ..plans.held import fresh_path
    from ..streaming.counts import events_stream
    from ..streaming.labels import UNDO, run

    events = events_stream(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 7 == 0, UNDO).otherwise(F.col("event_type")).alias("label"), "ts")
    root = fresh_path(spark, "labels")
    return run(events, f"{root}/out", f"{root}/state").select(F.col("key").alias("user_id"), F.col("seq").alias("last_event"), "label", "versions")


def oracles() -> dict[str, str]:
    return {
        "prepare_dataset": "SELECT doc_id, lang AS silo, (1 - quality)::INT AS y, md5(coalesce(nullif(trim(lower(string_split(text, chr(10))[1])), ''), 'no_title_' || doc_id)) AS grp FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL",
        "label_stream": "WITH g AS (SELECT CAST(user_id AS VARCHAR) AS user_id, list([CASE WHEN event_id % 7 = 0 THEN 'undo' ELSE event_type END] ORDER BY event_id) AS l, max(event_id) AS last_event, count(*) FILTER (event_id % 7 <> 0) AS versions FROM events GROUP BY user_id), "
        "s AS (SELECT *, list_reduce([CAST([] AS VARCHAR[])] || l, lambda a, b: CASE WHEN b[1] = 'undo' THEN a[1:len(a) - 1] ELSE a || b END) AS stands FROM g) SELECT user_id, last_event, stands[-1] AS label, versions FROM s",
    }


QUERIES = {
    "label_stream": label_stream,
    "prepare_dataset": lambda spark, d: prepare_dataset(_read(spark, d, "documents"), _read(spark, d, "labels")),
    "logreg_balanced": _model_query(lambda: LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", regParam=0.01, standardization=True)),
    "random_forest": _model_query(lambda: RandomForestClassifier(featuresCol="x", labelCol="y", weightCol="weight", numTrees=20, seed=1)),
    "gbt_histogram": _model_query(lambda: GBTClassifier(featuresCol="x", labelCol="y", weightCol="weight", maxIter=20, maxDepth=4, seed=1)),
    "svm_platt": lambda spark, d: platt_scores(_rows(spark, d), LinearSVC(featuresCol="x", labelCol="y", weightCol="weight", maxIter=30)),
    "pca_2d": lambda spark, d: pca_projection(_read(spark, d, "embeddings")),
    "streaming_label_counts": streaming_label_counts,
}
