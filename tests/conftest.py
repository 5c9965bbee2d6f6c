from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from sigtrace.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="sigtrace-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ["events"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


PACKET_COLS = (
    "packet_number bigint, timestamp double, timestamp_iso string, timestamp_hour timestamp, length int, "
    "protocol string, message_type string, interface string, direction string, ue_id string, source_ip string, "
    "destination_ip string, destination_port int, protocol_fields_json string"
)


def make_packets(spark, rows):
    """rows: dicts with packet_number, protocol, message_type, fields (dict) and optional extras."""
    import datetime
    import json

    out = []
    for r in rows:
        ts = float(r.get("timestamp", 1704067200 + r["packet_number"]))
        dt = datetime.datetime.fromtimestamp(ts, tz=datetime.timezone.utc).replace(tzinfo=None)
        out.append((
            r["packet_number"], ts, dt.isoformat(), dt.replace(minute=0, second=0, microsecond=0),
            r.get("length", 100), r.get("protocol"), r.get("message_type"), r.get("interface"), r.get("direction"),
            r.get("ue_id"), "10.0.0.1", "10.0.0.2", r.get("destination_port"), json.dumps(r.get("fields", {})),
        ))
    return spark.createDataFrame(out, PACKET_COLS)
