"""Run queries in Spark and their DuckDB oracle side by side and compare results.

usage: python tools/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, ".")

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm_rows(pdf):
    cols = sorted(pdf.columns)
    rows = []
    for rec in pdf[cols].itertuples(index=False):
        out = []
        for v in rec:
            if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
                out.append("NULL")
            elif isinstance(v, float):
                out.append(f"{v:.6f}")
            else:
                out.append(str(v))
        rows.append(tuple(out))
    return cols, sorted(rows)


def main():
    from sigtrace.session import local_session
    from sigtrace.registry import QUERIES, ORACLES, load_all

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    load_all()
    spark = local_session()
    con = duckdb.connect()
    if os.environ.get("COMPARE_TZ", "UTC"):
        con.execute(f"SET TimeZone='{os.environ.get('COMPARE_TZ', 'UTC')}'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for name in names or list(QUERIES):
        t0 = time.time()
        try:
            sdf = QUERIES[name](spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SPARK {name}: {str(e)[:1500]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in ORACLES:
            print(f"rows-only {name}: {len(sdf)} rows ({ts:.1f}s)")
            continue
        try:
            odf = con.sql(ORACLES[name]()).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SQL {name}: {str(e)[:1500]}")
            bad += 1
            continue
        sc, sr = norm_rows(sdf)
        oc, orr = norm_rows(odf)
        ok = sc == oc and sr == orr
        if not ok:
            bad += 1
            print(f"MISMATCH {name}: spark {len(sr)} rows {sc}; oracle {len(orr)} rows {oc}")
            ss, os_ = set(sr), set(orr)
            print("  spark-only ", list(ss - os_)[:3])
            print("  oracle-only ", list(os_ - ss)[:3])
        else:
            print(f"ok {name}: {len(sr)} rows ({ts:.1f}s)")
    print("bad:", bad)


if __name__ == "__main__":
    main()
