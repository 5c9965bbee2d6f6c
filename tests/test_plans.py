"""Physical-plan properties every operator must keep (checked on a written packets table)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def packets_table(spark, tmp_path_factory):
    from sigtrace.sources.events_projection import packets_from_events

    path = str(tmp_path_factory.mktemp("pk") / "packets")
    p = packets_from_events(spark, SF_SMALL)
    p.select("*", F.from_json("protocol_fields_json", "map<string,string>").alias("fields")).write.parquet(path)
    return spark.read.parquet(path)


def _plan(df) -> str:
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_no_cartesian_or_nested_loop_joins(packets_table):
    from sigtrace.registry import OPERATORS, load_all

    load_all()
    offenders = {}
    for name, op in sorted(OPERATORS.items()):
        plan = _plan(op(packets_table))
        bad = [w for w in ("CartesianProduct", "BroadcastNestedLoopJoin") if w in plan]
        if bad:
            offenders[name] = bad
    assert offenders == {}


def test_plain_filters_reach_the_scan(packets_table):
    from sigtrace.operators.listing import measurement_reports

    plan = _plan(measurement_reports(packets_table))
    assert "PushedFilters: [IsNotNull(protocol), IsNotNull(message_type), EqualTo(protocol,RRC), EqualTo(message_type,measurementReport)]" in plan


def test_column_pruning(packets_table):
    from sigtrace.operators.listing import count_by_protocol

    plan = _plan(count_by_protocol(packets_table))
    assert "ReadSchema: struct<protocol:string>" in plan


def test_top_k_per_group_is_a_group_limit(packets_table):
    from sigtrace.operators.catalog import field_samples

    assert "WindowGroupLimit" in _plan(field_samples(packets_table))


def test_json_parsed_once_per_row(spark):
    from sigtrace.functions.fields import has_key, with_fields
    from tests.conftest import make_packets

    p = make_packets(spark, [{"packet_number": 1, "protocol": "RRC", "fields": {"a.b": "1"}}])
    q = with_fields(p).where((F.col("protocol") == "RRC") & has_key(F.col("m"), lambda k: k.contains("a")) & F.col("m")["x"].isNull())
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_sampled_catalog_limits_per_type_before_shuffle(packets_table):
    from sigtrace.operators.catalog import field_catalog

    df = field_catalog(packets_table, sample_per_type=5)
    assert "WindowGroupLimit" in _plan(df)
    assert df.agg(F.max("packets")).collect()[0][0] <= 5


def test_hot_id_column_predicate_is_pushed(spark, packets_table, tmp_path):
    from sigtrace.operators.predicates import field_equals
    from sigtrace.sources.schema import HOT_KEYS

    path = str(tmp_path / "hot")
    packets_table.select("*", *[F.col("fields")[k].alias(c) for c, k in HOT_KEYS.items()]).write.parquet(path)
    t = spark.read.parquet(path)
    df = field_equals(t, "ngap.ngap.procedureCode", "29")
    assert "EqualTo(ngap_procedure_code,29)" in _plan(df)
    assert df.count() == packets_table.where(F.col("fields")["ngap.ngap.procedureCode"] == "29").count()
