"""Every plan against DuckDB on the smallest tables, and the operators that SQL cannot state."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from sievewright.queries import QUERIES, SQL

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: A part of the plans, so that the suite stays short; the driver runs them all.
SOME = sorted(SQL)[:: max(1, len(SQL) // 40)]


def canon(df):
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
            return None
        return round(float(v), 4) + 0.0 if isinstance(v, (int, float, np.number, bool, np.bool_)) or type(v).__name__ == "Decimal" else str(v)

    return sorted(repr([one(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(DIR):
        c.execute(f"create view {f[:-8]} as select * from '{DIR}/{f}'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_plan(spark, con, name):
    mine, theirs = QUERIES[name](spark, DIR).toPandas(), con.execute(SQL[name]).fetchdf()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert canon(mine) == canon(theirs)


@pytest.mark.parametrize("name", ["logreg_balanced", "kcenter_greedy", "pca_2d", "within_silo_cv", "stack_meta", "paired_bootstrap", "hierarchical_linkage", "optimise_spec", "induce_rule_set"])
def test_rows_only(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


@pytest.mark.parametrize("left", ["nothing", "byte code"])
def test_imports_without_corpus_operators(tmp_path, left):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/sievewright", tmp_path / "sievewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    if left == "byte code":
        os.makedirs(tmp_path / "sievewright/llm/__pycache__")
    code = "import __spark_entry__ as e; assert len(e.queries()) > 200 and len(e.oracle_sql()) > 200 and not any(k.startswith('op1_') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
