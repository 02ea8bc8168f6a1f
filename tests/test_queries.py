"""Every query with an oracle gives the oracle's rows on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tidewake.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def canonical(df: pd.DataFrame) -> list:
    def cell(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return "NULL"
        return repr(round(float(v), 6) + 0.0) if isinstance(v, float) else str(v)

    # a column of integers with nulls arrives as floats on one side only
    whole = {c for c in df.columns if pd.api.types.is_float_dtype(df[c]) and (df[c].dropna() % 1 == 0).all()}
    rows = df[sorted(df.columns)].to_dict("split")["data"]
    names = sorted(df.columns)
    return sorted([tuple(str(int(v)) if n in whole and not pd.isna(v) else cell(v) if not isinstance(v, int) or isinstance(v, bool) else str(v) for n, v in zip(names, r)) for r in rows])


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_oracle(name, spark, oracle):
    got = catalogue.queries()[name](spark, SF).toPandas()
    want = oracle.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(name, spark):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
