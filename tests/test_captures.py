"""Packets belong to the capture they were read from, whatever files a table is stored in."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL, make_packets


@pytest.fixture(scope="module")
def packets(spark):
    from sigtrace.sources.events_projection import packets_from_events

    return packets_from_events(spark, SF_SMALL)


def rows(df):
    return sorted(df.collect(), key=repr)


def test_a_stored_table_is_one_capture_in_any_number_of_files(spark, packets, tmp_path):
    from sigtrace.capture_queries import stored
    from sigtrace.operators import callflow as T

    table = stored(packets.repartition(7), str(tmp_path / "packets"))
    assert table.select("_metadata.file_path").distinct().count() > 1
    assert [r.capture for r in table.select("capture").distinct().collect()] == [str(tmp_path / "packets")]
    for fn in (T.session_packets, T.session_summary, T.session_phases, T.ran_id_evolution, T.enriched_call_flow, T.handover_flow, T.session_steps):
        plain = fn(packets)
        names = [c for c in plain.columns if c not in ("m", "fields")]
        assert rows(plain.select(*names)) == rows(fn(table).select(*names)), fn.__name__
    assert T.session_packets(table).select("session").distinct().count() == T.session_packets(packets).select("session").distinct().count()


def test_ingest_names_the_source_file(spark, tmp_path):
    from sigtrace.sources.packets import load_packets, normalize_packets, read_jsonl, write_packets
    from sigtrace.sources.pdml import read_pdml

    record = '{"packet_number": %d, "timestamp": 1704067200.5, "protocol": "NGAP", "protocol_fields": {"ngap.ngap.RAN_UE_NGAP_ID": "1"}}\n'
    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text(record % 1 + record % 2 + "{broken\n")
        (tmp_path / f"{name}.pdml").write_text('<pdml><packet><proto name="frame"><field name="frame.number" show="1"/></proto></packet><packet><proto name="ip"/></packet></pdml>')
    good, bad = read_jsonl(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")])
    write_packets(normalize_packets(good), str(tmp_path / "table"))
    back = load_packets(spark, str(tmp_path / "table"))
    assert sorted((r.capture.rsplit("/", 1)[1], r.packet_number) for r in back.collect()) == [(f"{n}.jsonl", i) for n in "ab" for i in (1, 2)]
    assert sorted(r.capture.rsplit("/", 1)[1] for r in bad.collect()) == ["a.jsonl", "b.jsonl"]
    good, bad = read_pdml(spark, str(tmp_path / "*.pdml"))
    assert sorted(r.capture.rsplit("/", 1)[1] for r in good.collect()) == ["a.pdml", "b.pdml"] and bad.count() == 2
    named, _ = read_pdml(spark, str(tmp_path / "a.pdml"), capture="first")
    assert [r.capture for r in named.collect()] == ["first"]


def test_counters_of_two_captures_are_different_ues(spark):
    """Shared counters without a common IMSI: separate groups; a common IMSI joins them."""
    from sigtrace.operators import correlate as G

    fields = [
        ("a", 1, {"s1ap.s1ap.ENB_UE_S1AP_ID": "5", "s1ap.s1ap.MME_UE_S1AP_ID": "9"}),
        ("b", 1, {"s1ap.s1ap.ENB_UE_S1AP_ID": "5", "s1ap.s1ap.MME_UE_S1AP_ID": "9"}),
        ("a", 2, {"s1ap.s1ap.ENB_UE_S1AP_ID": "6", "e212.imsi": "262019999"}),
        ("b", 2, {"s1ap.s1ap.ENB_UE_S1AP_ID": "7", "e212.imsi": "262019999"}),
    ]
    p = make_packets(spark, [{"packet_number": n, "fields": f} for _, n, f in fields])
    tables = [make_packets(spark, [{"packet_number": n, "fields": f} for c, n, f in fields if c == name]).withColumn("capture", F.lit(name)) for name in "ab"]
    both = tables[0].unionByName(tables[1])
    groups = G.ue_groups(both)
    got = {}
    for r in groups.collect():
        got.setdefault(r.ue_group, set()).add((r.capture, r.id_type, r.value, r.first_packet))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, [
        {("a", "enb_ue_s1ap_id", "5", 1), ("a", "mme_ue_s1ap_id", "9", 1)},
        {("b", "enb_ue_s1ap_id", "5", 1), ("b", "mme_ue_s1ap_id", "9", 1)},
        {("a", "enb_ue_s1ap_id", "6", 2), ("b", "enb_ue_s1ap_id", "7", 2), ("a", "imsi", "262019999", 2), ("b", "imsi", "262019999", 2)},
    ]))
    assert tuple(G.ue_group_stats(groups).first())[:2] == (3, 7)  # the IMSI counts once
    target = spark.createDataFrame([("a", "enb_ue_s1ap_id", "5")], "capture string, id_type string, value string")
    assert sorted((r.capture, r.packet_number) for r in G.expand_by_correlation(both, groups, target).collect()) == [("a", 1)]
    anywhere = target.drop("capture")
    assert sorted((r.capture, r.packet_number) for r in G.expand_by_correlation(both, groups, anywhere).collect()) == [("a", 1), ("b", 1)]
    # without a capture column the same counters are one UE, as before
    assert G.ue_group_stats(G.ue_groups(p)).first().total_groups == 2


def test_packets_without_a_number_stay(spark, packets):
    """NULL packet numbers come first and no row is lost."""
    from sigtrace.operators import callflow as T

    some = packets.withColumn("packet_number", F.when(F.col("packet_number") % 10 != 0, F.col("packet_number")))
    for fn in (T.enriched_call_flow, T.handover_flow, T.session_steps):
        for chunk in (5, 10**6):
            assert fn(some, chunk_size=chunk).count() == fn(packets).count(), fn.__name__
    phases = T.session_phases(some).agg(F.sum("messages")).first()[0]
    assert phases == T.session_packets(packets).count()
    flow = T.handover_flow(some).where("step = 1 AND packet_number IS NULL").count()
    assert flow == T.handover_flow(some).where("packet_number IS NULL").select("trace_ue").distinct().count()


def test_stored_layers(spark, tmp_path):
    """A7 and B10 work on a loaded table."""
    from sigtrace.operators import enrich as B
    from sigtrace.sources.events_projection import packets_from_events
    from sigtrace.sources.packets import filter_by_protocol_stack, load_packets, normalize_packets, with_layers, write_packets

    layered = B.layers_from_fields(packets_from_events(spark, SF_SMALL))
    write_packets(normalize_packets(B.enrich_packets(layered)), str(tmp_path / "t"))
    table = load_packets(spark, str(tmp_path / "t"))
    assert filter_by_protocol_stack(table).count() == filter_by_protocol_stack(layered).count() > 0
    count = lambda d: d.select(F.size(B.protocol_layer("NGAP")["fields"]).alias("n")).groupBy().agg(F.sum("n")).first()[0]
    assert count(with_layers(table)) == count(layered)


def test_ingest_run_parses_once(spark, tmp_path):
    from sigtrace.sources.ingest import ingest_run
    from sigtrace.sources.packets import load_packets

    (tmp_path / "a.pdml").write_text('<pdml>' + "".join(f'<packet><proto name="frame"><field name="frame.number" show="{i}"/></proto></packet>' for i in range(5)) + "<packet><proto/></packet></pdml>")
    got = ingest_run(spark, str(tmp_path / "a.pdml"), str(tmp_path / "out"))
    assert (got["packets"], got["malformed"]) == (5, 1) and got["output_bytes"] > 0
    assert load_packets(spark, str(tmp_path / "out")).count() == 5
    assert [r._error for r in spark.read.parquet(str(tmp_path / "out_rejects")).collect()] == ["ValueError: packet has no frame protocol"]


def test_point_lookups_reach_the_scan(spark, packets, tmp_path):
    """A lookup by any spelling of an id is a filter on a plain column; packets whose spellings differ are not lost."""
    from sigtrace.capture_queries import stored
    from sigtrace.operators import predicates as D
    from tests.test_plans import _plan

    odd = make_packets(spark, [{"packet_number": 5000, "fields": {"RAN_UE_NGAP_ID": "1402", "ngap.ngap.RAN_UE_NGAP_ID": "7"}}, {"packet_number": 5001, "fields": {"RAN_UE_NGAP_ID": "1402"}}])
    both = packets.unionByName(odd)
    table = stored(both, str(tmp_path / "t"))
    for find in (lambda p: D.ue_anchor(p, "ran", "1402"), lambda p: D.ue_anchor(p, "enb", "3"), lambda p: D.field_equals_any(p, "m_tmsi", "400000"), lambda p: D.ue_anchor(p, "ran", "7")):
        want = sorted(r.packet_number for r in find(both).collect())
        assert sorted(r.packet_number for r in find(table).collect()) == want and want
    plan = _plan(D.ue_anchor(table, "ran", "1402"))
    assert "PushedFilters: [Or(EqualTo(hot_ran,1402),EqualTo(hot_ids_differ,true))]" in plan
    assert "PushedFilters: [Or(EqualTo(hot_m_tmsi,400000)" in _plan(D.field_equals_any(table, "m_tmsi", "400000"))


def test_field_lookup_by_dictionary_scans_once(spark, packets, tmp_path):
    from sigtrace.capture_queries import stored
    from sigtrace.operators import lookup as V
    from tests.test_plans import _plan

    table = stored(packets, str(tmp_path / "t")).drop("capture")
    dictionary = V.write_field_dictionary(table, str(tmp_path / "d"))
    plan = _plan(V.field_values(table, "pdn_ipv4", dictionary))
    scans = [line for line in plan.splitlines() if line.startswith("Location:")]
    assert sum(line.rstrip().endswith("/t]") for line in scans) == 1, scans
    for name in ("pdn_ipv4", "hnb name", "q-RxLevMin", "m tmsi", "no such field"):
        assert rows(V.field_values(table, name, dictionary)) == rows(V.field_values(table, name)), name


def test_pretty_results(spark, tmp_path):
    import json

    from sigtrace.sources.packets import write_results

    write_results(spark.createDataFrame([(1, None)], "a int, b string").coalesce(1), str(tmp_path / "r"), pretty=True)
    text = next((tmp_path / "r").glob("part-*")).read_text()
    assert json.loads(text) == {"a": 1, "b": None} and "\n" in text.strip()
