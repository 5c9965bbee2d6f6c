"""Literal expectations for operator rules read from the reference (hand-made packets)."""

from __future__ import annotations

from tests.conftest import make_packets


def test_handover_flow_sticky_type_and_phase(spark):
    from sigtrace.operators.callflow import handover_flow

    p = make_packets(spark, [
        {"packet_number": 1, "protocol": "S1AP", "message_type": "HandoverPreparation",
         "fields": {"s1ap.s1ap.ENB_UE_S1AP_ID": "5", "s1ap.s1ap.HandoverRequired_element": ""}},
        {"packet_number": 2, "protocol": "S1AP", "message_type": "HandoverResourceAllocation",
         "fields": {"s1ap.s1ap.ENB_UE_S1AP_ID": "5"}},
        {"packet_number": 3, "protocol": "S1AP", "message_type": "HandoverRequest",
         "fields": {"s1ap.s1ap.ENB_UE_S1AP_ID": "5"}},
        {"packet_number": 4, "protocol": "S1AP", "message_type": "UEContextRelease",
         "fields": {"s1ap.s1ap.ENB_UE_S1AP_ID": "5", "s1ap.s1ap.MME_UE_S1AP_ID": "9"}},
    ])
    rows = {r.packet_number: r for r in handover_flow(p).where("trace_ue = '5'").collect()}
    assert [rows[i].flow for i in (1, 2, 3, 4)] == ["START", "->", "->", "END"]
    assert rows[1].message_type == "HandoverRequired"  # specific *_element name shown
    assert [rows[i].ho_type for i in (1, 2, 3, 4)] == ["S1"] * 4  # sticky through UEContextRelease
    assert [rows[i].phase for i in (1, 2, 3, 4)] == ["UNKNOWN", "UNKNOWN", "PREPARATION", "COMPLETION"]
    assert rows[4].mme_ue_id == "9" and rows[1].mme_ue_id == "-"


def test_field_values_two_tiers(spark):
    from sigtrace.operators.lookup import field_values

    p = make_packets(spark, [
        {"packet_number": 1, "fields": {"s1ap.s1ap.HNB_Name": "cell-a", "s1ap.s1ap.hnbname_flag": "1"}},
        {"packet_number": 2, "fields": {"s1ap.nas-eps.esm.pdn_ipv4": "10.1.1.1", "s1ap.s1ap.ENB_UE_S1AP_ID": "3"}},
    ])
    # no exact name for "hnb name" (blank kept) -> fuzzy tier; flag fields hidden
    assert [(r.field, r.value) for r in field_values(p, "hnb name").collect()] == [("s1ap.s1ap.HNB_Name", "cell-a")]
    r = field_values(p, "pdn_ipv4").collect()
    assert [(x.packet_number, x.ue_id, x.field, x.value) for x in r] == [(2, "3", "s1ap.nas-eps.esm.pdn_ipv4", "10.1.1.1")]


def test_field_name_variants_phy_phys(spark):
    from sigtrace.operators.predicates import field_name_variants

    p = make_packets(spark, [
        {"packet_number": 1, "fields": {"rlc_lte.lte-rrc.physCellId": "12"}},
        {"packet_number": 2, "fields": {"rlc_lte.lte-rrc.phyCellId": "13"}},
        {"packet_number": 3, "fields": {"rlc_lte.lte-rrc.q-RxLevMin": "-60"}},
    ])
    assert sorted(r.packet_number for r in field_name_variants(p, "phyCellId").collect()) == [1, 2]
    assert sorted(r.packet_number for r in field_name_variants(p, "phys_cell_id").collect()) == [1, 2]
    assert [r.packet_number for r in field_name_variants(p, "q_rxlevmin").collect()] == [3]


def test_resolve_field_prefers_value_over_flag(spark):
    from sigtrace.operators.catalog import resolve_field

    p = make_packets(spark, [
        {"packet_number": 1, "message_type": "X", "fields": {"s1ap.nas-eps.emm.m_tmsi_flag": "1", "s1ap.nas-eps.emm.m_tmsi": "77"}},
    ])
    assert [r.field for r in resolve_field(p, "m_tmsi").collect()] == ["s1ap.nas-eps.emm.m_tmsi"]


def test_release_cause_fallbacks(spark):
    from sigtrace.operators.release import release_events

    p = make_packets(spark, [
        # decoded 3GPP cause
        {"packet_number": 1, "fields": {"ngap.ngap.procedureCode": "41", "ngap.ngap.RAN_UE_NGAP_ID": "1",
                                        "ngap.ngap.Cause": "0", "ngap.ngap.radioNetwork": "20"}},
        # unknown value of a known group
        {"packet_number": 2, "fields": {"ngap.ngap.UEContextReleaseCommand_element": "", "ngap.ngap.Cause": "1",
                                        "ngap.ngap.transport": "9"}},
        # no group: first key mentioning 'cause'
        {"packet_number": 3, "fields": {"ngap.ngap.UEContextReleaseRequest_element": "", "ngap.ngap.causeText": "user-inactivity timer"}},
        # no cause key: first value with a hint word
        {"packet_number": 4, "fields": {"ngap.ngap.UEContextReleaseRequest_element": "", "x.y": "handover-triggered"}},
        # unknown group: its own value is the first 'cause' key
        {"packet_number": 5, "fields": {"ngap.ngap.UEContextReleaseRequest_element": "", "ngap.ngap.Cause": "9"}},
        # nothing at all
        {"packet_number": 6, "fields": {"ngap.ngap.UEContextReleaseCommand_element": ""}},
        # not a release packet
        {"packet_number": 7, "fields": {"ngap.ngap.procedureCode": "21"}},
    ])
    got = {r.packet_number: (r.cause_raw, r.cause_category, r.normal, r.release_type) for r in release_events(p).collect()}
    assert got == {
        1: ("user-inactivity", "inactivity", True, "Complete"),
        2: ("transport-9", "other", True, "Command"),
        3: ("user-inactivity timer", "inactivity", True, "Request"),
        4: ("handover-triggered", "triggered", False, "Request"),
        5: ("9", "other", True, "Request"),
        6: ("unspecified", "other", True, "Command"),
    }
    # the reference's own release code (21) as a parameter
    assert 7 in {r.packet_number for r in release_events(p, release_codes=("21",)).collect()}


def test_enriched_call_flow_nas_and_delta(spark):
    from sigtrace.operators.callflow import enriched_call_flow

    p = make_packets(spark, [
        {"packet_number": 1, "timestamp": 100.0, "fields": {"ngap.ngap.procedureCode": "4", "ngap.ngap.RAN_UE_NGAP_ID": "8",
                                                            "ngap.nas-5gs.mm.message_type": "0x41"}},
        {"packet_number": 2, "timestamp": 100.2505, "fields": {"ngap.ngap.procedureCode": "99", "ngap.ngap.RAN_UE_NGAP_ID": "8"}},
        {"packet_number": 3, "timestamp": 101.0, "fields": {"ngap.ngap.procedureCode": "46", "ngap.ngap.RAN_UE_NGAP_ID": "8",
                                                            "ngap.nas-5gs.mm.message_type": "0x42", "ngap.ngap.pDUSessionID": "1"}},
    ])
    rows = {r.packet_number: r for r in enriched_call_flow(p).collect()}
    assert sorted(rows) == [1, 3]  # unknown procedure 99 without PDU / IP is left out
    assert rows[1].step == 1 and rows[3].step == 2
    assert rows[1].notes == "NAS: Registration request" and rows[1].flow_dir == "DOWNLINK"
    assert rows[3].notes == "NAS: Registration accept, PDU=1" and rows[3].flow_dir == "UPLINK"
    assert rows[1].delta_ms is None and rows[3].delta_ms == 749.0  # delta from the previous anchored packet
    assert rows[1].iso_time == "1970-01-01T00:01:40.000Z"


def test_ue_has_message_prefix_and_submessage(spark):
    from sigtrace.operators.release import ue_has_message

    p = make_packets(spark, [
        {"packet_number": 1, "message_type": "HandoverPreparation",
         "fields": {"ngap.ngap.RAN_UE_NGAP_ID": "4", "ngap.ngap.HandoverCommand_element": ""}},
        {"packet_number": 2, "message_type": "HandoverNotification", "fields": {"ngap.ngap.RAN_UE_NGAP_ID": "4"}},
        {"packet_number": 3, "message_type": "InitialContextSetup", "fields": {"ngap.ngap.RAN_UE_NGAP_ID": "5"}},
    ])
    req = spark.createDataFrame([("4", "Handover Command"), ("4", "handover notify"), ("5", "UEContextRelease")], "ue_id string, message string")
    got = sorted((r.message, r.packet_number, r.matched_message) for r in ue_has_message(p, req).collect())
    assert ("Handover Command", 1, "HandoverPreparation (HandoverCommand)") in got
    # 'handovernotify' vs 'handovernotification': first 80 % of the shorter name agree
    assert ("handover notify", 2, "HandoverNotification") in got
    assert all(r[0] != "UEContextRelease" for r in got)


def test_shared_session_table_gives_same_results(spark, tmp_path):
    from tests.conftest import SF_SMALL

    from sigtrace.operators import callflow as T
    from sigtrace.sources.events_projection import packets_from_events

    p = packets_from_events(spark, SF_SMALL)
    shared = T.write_sessions(p, str(tmp_path / "sessions"))
    for fn in (T.session_summary, T.session_phases, T.ran_id_evolution, T.session_message_counts):
        a = sorted(tuple(r) for r in fn(p).collect())
        b = sorted(tuple(r) for r in fn(p, sessions=shared).collect())
        assert a == b, fn.__name__
    assert T.ue_session(p, "1402", sessions=shared).count() == T.ue_session(p, "1402").count()
