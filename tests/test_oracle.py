"""Every registered query against its DuckDB oracle on the smallest driver tables."""

from __future__ import annotations

import math

import pandas as pd
import pytest

from tests.conftest import SF_SMALL

import __spark_entry__ as entry_mod

QUERIES = entry_mod.queries()
ORACLES = entry_mod.oracle_sql()


def _norm(pdf):
    cols = sorted(pdf.columns)
    rows = []
    for rec in pdf[cols].itertuples(index=False):
        vals = []
        for v in rec:
            if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
                vals.append("NULL")
            elif isinstance(v, float):
                vals.append(f"{v:.6f}")
            else:
                vals.append(str(v))
        rows.append(tuple(vals))
    return cols, sorted(rows)


@pytest.fixture(scope="module")
def duck_all():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert "cause_category" in df.columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck_all, name):
    sdf = QUERIES[name](spark, SF_SMALL).toPandas()
    if name not in ORACLES:
        assert len(sdf.columns) > 0
        return
    odf = duck_all.sql(ORACLES[name]).df()
    sc, sr = _norm(sdf)
    oc, orr = _norm(odf)
    assert sc == oc, f"columns differ: {sc} vs {oc}"
    assert len(sr) == len(orr), f"row counts differ: {len(sr)} vs {len(orr)}"
    assert sr == orr
