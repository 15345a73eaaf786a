"""SQL functions of this engine: a scalar Arrow function, a group aggregate and an SQL table function, registered on a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .vectors import auc


def light_stem(words: pd.Series) -> pd.Series:
    """ies -> y, sses -> ss, a trailing s after another letter goes."""
    return words.str.replace(r"ies$", "y", regex=True).str.replace(r"sses$", "ss", regex=True).str.replace(r"([^s])s$", r"\1", regex=True)


def tied_auc(y: pd.Series, s: pd.Series) -> float:
    """AUC of one bounded group; nulls are left out, one class gives null."""
    ok = y.notna() & s.notna()
    return auc(y[ok].to_numpy(), s[ok].to_numpy())


#: Rows (place, span) of a text's sentences, as a table function of SQL: it is inlined into the query, no row leaves the JVM.
SPANS = r"""CREATE OR REPLACE TEMPORARY FUNCTION spans(t STRING) RETURNS TABLE (place INT, span STRING)
RETURN SELECT pos, col FROM posexplode(split(regexp_replace(coalesce(t, ''), r'^\s+|\s+$', ''), r'(?<=[.!?])\s+')) WHERE col <> ''"""


def register(spark: SparkSession) -> None:
    """light_stem(word), tied_auc(y, score) and spans(text) for SQL of this session."""
    spark.udf.register("light_stem", F.pandas_udf(light_stem, "string"))
    spark.udf.register("tied_auc", F.pandas_udf(tied_auc, "double"))
    spark.sql(SPANS)
