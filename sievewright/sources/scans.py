"""Scans: by suffix, JSON lines behind a header record, nested JSON documents, and many files checked against their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan(spark: SparkSession, path: str, schema: StructType | str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A parquet, CSV, JSON-lines or ORC file or folder by the suffix of ``path``; only ``columns`` are read. An error for other suffixes."""
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if suffix in ("parquet", "orc"):
        df = reader.format(suffix).load(path)
    elif suffix == "csv":
        df = reader.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", schema is None).csv(path)
    elif suffix in ("json", "jsonl", "ndjson"):
        df = reader.json(path)
    else:
        raise ValueError(f"no reader for .{suffix}: {path}")
    return df.select(*columns) if columns else df


def scan_jsonl_meta(spark: SparkSession, path: str, schema: StructType | str, marker: str = "_meta") -> tuple[DataFrame, DataFrame]:
    """(header, rows): lines whose object has ``marker`` are the header's records, the others rows; broken lines are an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    # variant_get with null where the path is absent; parse_json fails on broken lines
    value = F.parse_json("value")
    is_meta = F.try_variant_get(value, f"$.{marker}", "string").isNotNull() | F.col("value").rlike(rf'"{marker}"\s*:\s*\{{')
    header = lines.where(is_meta).select("value")
    return header, lines.where(~is_meta).select(F.from_json("value", schema if isinstance(schema, str) else schema.simpleString(), {"mode": "FAILFAST"}).alias("r")).select("r.*")


def scan_json_docs(spark: SparkSession, path: str, schema: StructType | str, fields: dict[str, str]) -> DataFrame:
    """One flat row per nested JSON document: ``fields`` maps new names to paths such as "domain.industry"; absent ones are null."""
    docs = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return docs.select(*[F.col(p).alias(n) for n, p in fields.items()])


def scan_glob(spark: SparkSession, pattern: str, key: str, name_pattern: str = r"([^/]+)\.parquet$", schema: StructType | str | None = None) -> DataFrame:
    """All files of ``pattern``; an error unless every file's rows hold the ``key`` that its name says."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    rows = reader.parquet(pattern).withColumn("_file", F.regexp_extract(F.input_file_name(), name_pattern, 1))
    wrong = rows.where(~F.col(key).cast("string").eqNullSafe(F.col("_file"))).select("_file", key).limit(1).collect()
    if wrong:
        raise ValueError(f"file {wrong[0][0]} holds {key} = {wrong[0][1]}")
    return rows.drop("_file")
