"""Every catalogue query runs on sf0.001; every oracle twin agrees with Spark."""

import math

import pandas as pd
import pytest

import __spark_entry__ as E
from paths import SMALL

QUERIES = {k: v for k, v in E.queries().items() if k not in E.LLM_QUERIES}
ORACLES = E.oracle_sql()


def test_entry_has_rows(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == E.entry(spark).columns


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item") and not isinstance(v, (list, dict)):
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return float(f"{float(v):.9g}")
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().isoformat()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SMALL).toPandas()
    if name not in ORACLES:
        assert len(sdf) > 0 and not sdf.dropna(axis=1, how="all").empty
        return
    odf = duck.execute(ORACLES[name]).df()
    assert sorted(sdf.columns) == sorted(odf.columns)
    assert len(sdf) == len(odf)
    assert _rows(sdf) == _rows(odf)
