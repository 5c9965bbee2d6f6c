"""Operator tests on hand-written inputs with literal expectations."""

from __future__ import annotations

import pytest

import os

from pyspark.sql import functions as F

from tests.conftest import make_packets

DATA = os.path.join(os.path.dirname(__file__), "data")


# --- Q2 / Q3: literals of the reference's own unit tests ------------------------------
def test_ue_filter_in_sql_reference_literals(spark):
    from sigtrace.operators.sqlsurface import ue_filter_in_sql

    texts = [
        (1, "SELECT * FROM packets WHERE protocol_fields_json LIKE '%\"ngap.RAN_UE_NGAP_ID\": \"42\"%'"),
        (2, "SELECT * FROM packets WHERE ngap.RAN_UE_NGAP_ID = '99'"),
        (3, "SELECT * FROM packets"),
    ]
    out = {r.query_id: (r.ue_field, r.ue_value) for r in ue_filter_in_sql(spark.createDataFrame(texts, "query_id int, text string")).collect()}
    assert out[1] == ("ngap.RAN_UE_NGAP_ID", "42")
    assert out[2] == ("ngap.RAN_UE_NGAP_ID", "99")
    assert out[3] == (None, None)


def test_handover_spellings_map_to_preparation(spark):
    from sigtrace.operators.sqlsurface import tag_message_types

    qs = ["value in handover required msg", "show handoverrequired", "handoverRequired KPIs"]
    df = tag_message_types(spark.createDataFrame([(i, q) for i, q in enumerate(qs)], "question_id int, text string"))
    assert {r.message_type_value for r in df.collect()} == {"HandoverPreparation"}


def test_message_type_in_resolves_synonyms(spark):
    from sigtrace.operators.predicates import message_type_in

    p = make_packets(spark, [
        {"packet_number": 1, "message_type": "HandoverPreparation"},
        {"packet_number": 2, "message_type": "measurementReport"},
        {"packet_number": 3, "message_type": "paging"},
    ])
    got = sorted(r.packet_number for r in message_type_in(p, ["Handover Required", "measurement report"]).collect())
    assert got == [1, 2]


# --- F: measurement extraction --------------------------------------------------------
def test_rsrp_rsrq_text_literals(spark):
    from sigtrace.operators.measure import rsrp_to_dbm, rsrq_to_db

    df = spark.createDataFrame([(48, 28), (98, 35), (None, None), (0, 0)], "p int, q int")
    rows = df.select(rsrp_to_dbm(F.col("p")).alias("a"), rsrq_to_db(F.col("q")).alias("b")).collect()
    assert rows[0].a == "-92dBm to -91dBm" and rows[0].b == "-5.5dB to -5.0dB"
    assert rows[1].a == "Unknown" and rows[1].b == "Unknown"
    assert rows[2].a == "Unknown" and rows[2].b == "Unknown"
    assert rows[3].a == "-140dBm to -139dBm" and rows[3].b == "-19.5dB to -19.0dB"


def test_pcell_context_wins_and_neighbour_rule(spark):
    from sigtrace.operators.measure import rsrp_rsrq

    p = make_packets(spark, [
        # first occurrence is a neighbour value; pcell keys must win
        {"packet_number": 1, "fields": {"rlc_lte.lte-rrc.rsrpResult": "30", "rlc_lte.lte-rrc.rsrqResult": "5",
                                        "rlc_lte.lte-rrc.rsrpResult__context=pcell": "50",
                                        "rlc_lte.lte-rrc.rsrqResult__context=pcell": "20"}},
        # fallback: needs measResultPCell, skips neighbour-list keys
        {"packet_number": 2, "fields": {"rlc_lte.lte-rrc.measResultPCell_element": "",
                                        "rlc_lte.lte-rrc.measResultNeighCells.rsrpResult": "11",
                                        "rlc_lte.lte-rrc.rsrpResult": "44", "rlc_lte.lte-rrc.rsrqResult": "bad",
                                        "rlc_lte.lte-rrc.rsrqResult.x": "12"}},
        # no PCell element and no context keys: not a serving-cell report
        {"packet_number": 3, "fields": {"rlc_lte.lte-rrc.rsrpResult": "44", "rlc_lte.lte-rrc.rsrqResult": "12"}},
        # neighbours present and a value missing: dropped
        {"packet_number": 4, "fields": {"rlc_lte.lte-rrc.measResultPCell_element": "",
                                        "rlc_lte.lte-rrc.measResultListEUTRA": "", "rlc_lte.lte-rrc.rsrpResult": "44"}},
    ])
    got = {r.packet_number: (r.rsrp_result, r.rsrq_result) for r in rsrp_rsrq(p).collect()}
    assert got == {1: (50, 20), 2: (44, 12)}


# --- V5: PLMN / TAC on literal rows ----------------------------------------------------
def test_plmn_tac_first_in_packet_order(spark):
    from sigtrace.operators.lookup import plmn_tac

    p = make_packets(spark, [
        {"packet_number": 5, "fields": {"ngap.ngap.pLMNIdentity": "00f110", "ngap.ngap.tAC": "000001"}},
        {"packet_number": 3, "fields": {"ngap.e212.plmn-id.mcc": "001", "ngap.e212.plmn-id.mnc": "01", "ngap.ngap.tac": "7"}},
        {"packet_number": 1, "fields": {"ngap.ngap.contact": "tac-less", "ngap.ngap.pLMNIdentity": ""}},
    ])
    r = plmn_tac(p).collect()[0]
    assert r.plmn_identity == "MCC=001, MNC=01"
    assert r.tac == "7"


# --- A1 / A2: PDML ----------------------------------------------------------------------
def test_read_pdml_fields_context_and_rejects(spark):
    from sigtrace.sources.pdml import read_pdml

    good, bad = read_pdml(spark, os.path.join(DATA, "sample.pdml"))
    rows = {r.packet_number: r for r in good.collect()}
    assert sorted(rows) == [1, 2]
    assert bad.count() == 1
    p1 = rows[1]
    assert p1.protocol_stack == ["frame", "ip", "sctp", "ngap"]
    assert (p1.source_ip, p1.destination_ip, p1.source_port, p1.destination_port) == ("10.0.0.1", "10.0.0.2", 38412, 38413)
    ngap = p1.protocol_layers[3].fields
    assert ngap["ngap.dup"] == "second"  # last occurrence wins
    assert ngap["ngap.nested_child"] == "0a0b"  # value used when show is missing
    rrc = rows[2].protocol_layers[1].fields
    assert rrc["lte-rrc.rsrpResult"] == "50"  # first occurrence
    assert rrc["lte-rrc.rsrpResult__context=pcell"] == "50"
    assert rrc["lte-rrc.rsrqResult__context=pcell"] == "20"
    assert rrc["lte-rrc.rsrpResult__context=neigh[0]"] == "40"
    assert rrc["lte-rrc.rsrqResult__context=neigh[1]"] == "5"
    assert rows[2].timestamp == 1704067201.5


def test_enrich_from_pdml(spark):
    from sigtrace.operators.enrich import enrich_packets
    from sigtrace.sources.pdml import read_pdml

    good, _ = read_pdml(spark, os.path.join(DATA, "sample.pdml"))
    e = {r.packet_number: r for r in enrich_packets(good).collect()}
    assert e[1].message_type == "InitialUEMessage"
    assert e[1].protocol == "NGAP" and e[1].interface == "N2" and e[1].ue_id == "7"
    assert e[1].protocol_fields["ngap.ngap.procedureCode"] == "15"
    assert e[2].message_type == "measurementReport"
    assert e[2].protocol == "RRC" and e[2].interface is None  # rlc-lte is not 'rlc' (K23)


# --- A3 / A4: JSONL -----------------------------------------------------------------------
def test_read_jsonl_blank_and_malformed(spark):
    from sigtrace.sources.packets import normalize_packets, read_jsonl

    good, bad = read_jsonl(spark, os.path.join(DATA, "sample.jsonl"))
    assert sorted(r.packet_number for r in good.collect()) == [1, 2]
    assert bad.count() == 1
    n = {r.packet_number: r for r in normalize_packets(good).collect()}
    assert n[1].fields["ngap.ngap.RAN_UE_NGAP_ID"] == "12"  # numbers become text
    assert n[1].ran_ue_ngap_id == "12"
    assert n[2].timestamp is None and n[2].timestamp_hour is None  # unparsable time -> NULL, row kept


# --- Q1: read-only SQL ----------------------------------------------------------------------
def test_run_sql_read_only(spark):
    import pytest

    from sigtrace.operators.sqlsurface import run_sql, validate_read_only

    p = make_packets(spark, [{"packet_number": i, "protocol": "NGAP"} for i in range(1, 6)])
    assert run_sql(spark, p, "WITH t AS (SELECT * FROM packets) SELECT count(*) AS n FROM t").collect()[0].n == 5
    assert run_sql(spark, p, "SELECT * FROM packets", limit=2).count() == 2
    for bad in ["DROP TABLE packets", "SELECT 1; DROP TABLE x", "WITH t AS (SELECT 1) INSERT INTO x SELECT * FROM t",
                "CREATE TABLE x AS SELECT 1"]:
        with pytest.raises(ValueError):
            validate_read_only(bad)
    assert validate_read_only("SELECT 'drop table' AS s") == "SELECT 'drop table' AS s"


def test_run_sql_by_the_public_api(spark):
    import pytest

    from sigtrace.operators.sqlsurface import validate_read_only

    class Public:
        """A session with nothing but ``sql``."""

        def sql(self, text):
            return spark.sql(text)

    for good in ["SELECT 1 -- one", "WITH t AS (SELECT 1 AS a) SELECT * FROM t ORDER BY a;", "VALUES (1)", "SELECT * FROM not_there"]:
        assert validate_read_only(good, Public()) == good.rstrip(";")
    for bad in ["CLEAR CACHE", "SHOW TABLES", "RESET", "SET a=1", "CACHE TABLE x", "EXPLAIN SELECT 1", "FROM x INSERT INTO y SELECT *", "SELECT 1; SELECT 2", "DELETE FROM x", ""]:
        with pytest.raises(ValueError):
            validate_read_only(bad, Public())


# --- plans: chunked scans equal plain windows / sequential folds -------------------------------
def test_sequence_and_carry_forward_across_chunks(spark):
    from pyspark.sql import Window

    from sigtrace.plans.ordered import carry_forward, sequence

    rows = [("a" if i % 3 else "b", i, (i * 7) % 5 if i % 4 else None) for i in range(1, 200)]
    df = spark.createDataFrame(rows, "k string, o long, v int")
    got = carry_forward(sequence(df, "k", "o", lag_cols=["v"], chunk_size=7), "k", "o", "v", "last_v", chunk_size=5)
    w = Window.partitionBy("k").orderBy("o")
    ref = df.select(
        "k", "o", F.row_number().over(w).alias("seq"), F.lag("v").over(w).alias("prev_v"),
        F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("last_v"),
    )
    a = sorted(tuple(r) for r in got.select("k", "o", "seq", "prev_v", "last_v").collect())
    b = sorted(tuple(r) for r in ref.collect())
    assert a == b


def test_fsm_scan_chunked_equals_sequential(spark):
    import random

    from sigtrace.operators.callflow import PHASE_STATES, phase_step
    from sigtrace.plans.fsm import fsm_scan

    random.seed(7)
    rows = []
    for key in ["u1", "u2", "u3"]:
        for o in range(1, 120):
            rows.append((key, o, random.choice("IHPDOOOO")))
    df = spark.createDataFrame(rows, "k string, o long, s string")
    got = {(r.k, r.o): (r.state_id, r.segment, r.opened, r.first) for r in fsm_scan(df, "k", "o", "s", PHASE_STATES, (0, 0), phase_step, chunk_size=9).collect()}
    index = {s: i for i, s in enumerate(PHASE_STATES)}
    for key in ["u1", "u2", "u3"]:
        state, seg = (0, 0), 1
        for o in range(1, 120):
            sym = next(r[2] for r in rows if r[0] == key and r[1] == o)
            state, op = phase_step(state, sym)
            seg += int(op)
            assert got[(key, o)] == (index[state], seg, op, o == 1)


# --- G3: connected components vs brute force ---------------------------------------------------
def test_connected_components_long_chain(spark):
    from sigtrace.plans.components import connected_components

    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(0, 60)] + [("x1", "x2"), ("x3", "x3")]
    comp = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert all(comp[f"n{i:03d}"] == "n000" for i in range(61))
    assert comp["x1"] == comp["x2"] == "x1" and comp["x3"] == "x3"


# --- invariants on the driver tables --------------------------------------------------------------
def test_release_categories_sum_to_total(spark):
    from tests.conftest import SF_SMALL

    from sigtrace.operators.release import release_by_category, release_stats
    from sigtrace.sources.events_projection import packets_from_events

    p = packets_from_events(spark, SF_SMALL)
    total = release_stats(p).collect()[0].total_releases
    assert total == 130
    assert sum(r.total for r in release_by_category(p).collect()) == total


def test_session_for_one_target_matches_all_targets(spark):
    from tests.conftest import SF_SMALL

    from sigtrace.operators.callflow import session_packets, ue_session
    from sigtrace.sources.events_projection import packets_from_events

    p = packets_from_events(spark, SF_SMALL)
    one = {r.packet_number for r in ue_session(p, "1402").collect()}
    amfs = {r.amf for r in session_packets(p).where(F.col("ran") == "1402").where(F.col("amf").isNotNull()).collect()}
    allp = {r.packet_number for r in session_packets(p).where(F.col("session").isin(list(amfs))).collect()}
    assert one and one == allp


def test_stream_ingest_pdml(spark, tmp_path):
    from sigtrace.streaming.ingest import ingest_stream

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.pdml").write_text(open(os.path.join(DATA, "sample.pdml")).read())
    out = str(tmp_path / "out")
    q = ingest_stream(spark, str(src), out, fmt="pdml", checkpoint_path=str(tmp_path / "ckpt"))
    q.awaitTermination()
    got = spark.read.parquet(out)
    assert sorted(r.packet_number for r in got.collect()) == [1, 2]
    assert spark.read.parquet(out + "_rejects").count() == 1


def test_parse_run_summary_counts_from_the_write(spark, tmp_path):
    from sigtrace.sources.packets import normalize_packets, parse_run_summary, read_jsonl

    good, bad = read_jsonl(spark, os.path.join(DATA, "sample.jsonl"))
    s = parse_run_summary(normalize_packets(good), bad, str(tmp_path / "packets"))
    assert s["packets"] == 2 and s["malformed"] == 1 and s["output_bytes"] > 0
    assert spark.read.parquet(str(tmp_path / "packets")).count() == 2


def test_synonym_resolution_dataframe_matches_parameters(spark):
    from sigtrace.operators.predicates import canonical_message_values, resolve_message_types

    sp = ["Handover Required", "security mode command", "RRC Connection Setup Complete", "nonsense", "Attach Request"]
    df = resolve_message_types(spark.createDataFrame([(s,) for s in sp], "spelling string"))
    by_df = {r.spelling: r.message_type for r in df.collect()}
    assert canonical_message_values(sp) == [by_df[s] for s in sp if s in by_df]
    assert by_df["security mode command"] == "securityModeCommand"  # repeated spelling keeps its later value


def test_fsm_groups_straddle_arrow_batches(spark):
    """A key or chunk whose rows come in several Arrow batches is one run of the machine."""
    from sigtrace.plans.fsm import fsm_scan

    rows = [("a", i, "x") for i in range(25)] + [("b", i * 10**12, "x") for i in range(7)] + [(None, 1, "x"), ("c", None, "x"), ("c", 5, "x")]
    df = spark.createDataFrame(rows, "k string, o long, s string")
    step = lambda n, _: ((n + 1) % 50, n % 4 == 3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for chunk in (4, 1_000):
            got = sorted((r.k or "", -1 if r.o is None else r.o, r.state_id, r.segment, r.first, r.s) for r in fsm_scan(df, "k", "o", "s", range(50), 0, step, chunk, keep=("s",)).collect())
            want = [("", 1, 1, 1, True, "x")] + [("a", i, i + 1, 1 + (i + 1) // 4, i == 0, "x") for i in range(25)]
            want += [("b", i * 10**12, i + 1, 1 + (i + 1) // 4, i == 0, "x") for i in range(7)] + [("c", -1, 1, 1, True, "x"), ("c", 5, 2, 1, False, "x")]
            assert got == want, chunk
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_scan_carries_everything_over_chunks(spark):
    """Position, lag, last values, dependent last values, running sums and the last flag, with gaps and NULL order values."""
    import random

    from sigtrace.plans.ordered import scan

    rng = random.Random(3)
    rows = []
    for key, gap in (("hot", 1), ("wide", 10**13), ("small", 5), (None, 3)):
        size = {"hot": 300, "wide": 200, "small": 6, None: 40}[key]
        for i in range(size):
            rows.append((key, None if i == 0 else i * gap, rng.choice(["A", "B", None, None, None, None]), rng.choice("xyz"), rng.randint(0, 1), i))
    df = spark.createDataFrame(rows, "k string, o long, mode string, v string, n int, i int")
    for chunk in (7, 10**6):
        rules = {"A": F.when(F.col("v") == "x", "ax"), "B": F.when(F.col("v") == "y", "by"), None: F.when(F.col("v") == "z", "nz")}
        out = scan(df, "k", "o", seq="seq", lag={"prev": "v"}, last_value={"now": "mode"}, switched={"phase": ("now", rules)}, running={"sum": "n"}, last="end", chunk_rows=chunk)
        got = {(r.k, r.i): (r.seq, r.prev, r.now, r.phase, r["sum"], r.end) for r in out.collect()}
        assert len(got) == len(rows)
        for key in ("hot", "wide", "small", None):
            own = [r for r in rows if r[0] == key]
            now = phase = prev = None
            total = 0
            for pos, (_, _, mode, v, n, i) in enumerate(own, 1):
                now = mode or now
                phase = {("A", "x"): "ax", ("B", "y"): "by", (None, "z"): "nz"}.get((now, v), phase)
                total += n
                assert got[(key, i)] == (pos, prev, now, phase, total, pos == len(own)), (chunk, key, i)
                prev = v


def test_scan_cuts_a_heavy_key_into_even_chunks(spark):
    from sigtrace.plans.ordered import chunked

    rows = [("hot", i**3) for i in range(3_000)] + [(f"k{i}", i) for i in range(600)]
    out = chunked(spark.createDataFrame(rows, "k string, o long"), "k", "o", 100).groupBy("k", "_chunk").count().collect()
    hot = [r["count"] for r in out if r.k == "hot"]
    assert sum(hot) == 3_000 and max(hot) <= 100 and len(hot) > 30  # by rows, whatever the gaps
    assert all(r._chunk == 0 for r in out if r.k != "hot")


def test_write_packets_layouts(spark, tmp_path):
    import pytest

    from sigtrace.sources.packets import normalize_packets, read_jsonl, write_packets

    good, _ = read_jsonl(spark, os.path.join(DATA, "sample.jsonl"))
    n = normalize_packets(good)
    for layout in ("rebalance", "range", "none"):
        out = str(tmp_path / layout)
        write_packets(n, out, layout=layout)
        assert sorted(r.packet_number for r in spark.read.parquet(out).collect()) == [1, 2]
    with pytest.raises(ValueError):
        write_packets(n, str(tmp_path / "bad"), layout="zigzag")


# ---------------------------------------------------------------------------
# Several captures, several targets, no caps
# ---------------------------------------------------------------------------
def _two_captures(spark):
    from pyspark.sql import functions as F

    ngap = lambda ran, amf=None: {"ngap.ngap.RAN_UE_NGAP_ID": ran, **({"ngap.ngap.AMF_UE_NGAP_ID": amf} if amf else {})}
    rows = [
        {"packet_number": 1, "protocol": "NGAP", "message_type": "InitialUEMessage", "fields": ngap("7")},
        {"packet_number": 2, "protocol": "NGAP", "message_type": "DownlinkNASTransport", "fields": ngap("7", "70")},
        {"packet_number": 3, "protocol": "NGAP", "message_type": "UEContextRelease", "fields": ngap("7", "71")},
    ]
    one = make_packets(spark, rows).withColumn("capture", F.lit("a"))
    two = make_packets(spark, rows[:2]).withColumn("capture", F.lit("b"))
    return one.unionByName(two)


def test_sessions_of_two_captures_stay_apart(spark):
    from sigtrace.operators import callflow

    p = _two_captures(spark)
    got = sorted((r.capture, r.packet_number, r.session) for r in callflow.ue_session(p, "7").collect())
    assert got == [("a", 1, "7"), ("a", 2, "7"), ("a", 3, "7"), ("b", 1, "7"), ("b", 2, "7")]
    merged = callflow.ue_session(p, "7")
    assert callflow.session_steps(p, sessions=merged).count() == 5
    summary = {r.capture: (r.messages, r.ran_ids) for r in callflow.session_summary(p, sessions=merged).collect()}
    assert summary == {"a": (3, 1), "b": (2, 1)}
    assert sorted((r.capture, r.session, r.messages) for r in callflow.session_summary(p).collect()) == [("a", "70", 3), ("a", "71", 3), ("b", "70", 2)]


def test_every_target_is_answered(spark):
    from sigtrace.operators.predicates import field_equals_any, ue_anchor

    p = make_packets(spark, [{"packet_number": i, "protocol": "NGAP", "fields": {"ngap.ngap.RAN_UE_NGAP_ID": str(i)}} for i in range(4)])
    targets = spark.createDataFrame([("1",), ("2",), ("2",)], "value string")
    assert sorted(r.packet_number for r in ue_anchor(p, "ran", targets).collect()) == [1, 2]
    assert sorted(r.packet_number for r in field_equals_any(p, "ngap.ngap.RAN_UE_NGAP_ID", targets).collect()) == [1, 2]


def test_run_sql_by_its_plan(spark):
    from sigtrace.operators.sqlsurface import run_sql

    p = make_packets(spark, [{"packet_number": i, "message_type": "A_B"} for i in range(300)])
    assert run_sql(spark, p, "SELECT * FROM packets ORDER BY packet_number LIMIT 250 OFFSET 10").count() == 250
    assert run_sql(spark, p, "SELECT replace(message_type, '_', ' ') AS use FROM packets").count() == 300
    assert run_sql(spark, p, "WITH x AS (SELECT 1 AS a) SELECT * FROM x;").count() == 1
    for bad in ("DROP TABLE packets", "INSERT INTO packets SELECT * FROM packets", "SELECT 1; SELECT 2", "CREATE VIEW v AS SELECT 1", "SET a=b", "SELEC 1"):
        with pytest.raises(ValueError):
            run_sql(spark, p, bad)


def test_components_of_chains_in_any_order(spark):
    import random

    from sigtrace.plans.components import connected_components

    n = 300
    orders = [[0, *range(n, 0, -1)], random.Random(3).sample(range(n + 1), n + 1)]
    for order in orders:
        edges = spark.createDataFrame(list(zip(order, order[1:])), "src long, dst long")
        got = connected_components(edges).collect()
        assert len(got) == n + 1 and {r.component for r in got} == {0}


def test_plmn_and_tac_from_different_packets(spark):
    from sigtrace.operators.lookup import plmn_tac

    p = make_packets(spark, [{"packet_number": 1, "fields": {"ngap.ngap.tac": "12"}}, {"packet_number": 2, "fields": {"ngap.ngap.pLMNIdentity": "00f110"}}])
    assert tuple(plmn_tac(p).first()) == ("00f110", "12")


def test_csv_result_is_read_by_a_standard_reader(spark, tmp_path):
    import csv
    import glob

    from sigtrace.sources.packets import write_results

    text = '{"a.b": "1", "c": "2"}'
    write_results(spark.createDataFrame([(1, text)], "n int, t string").coalesce(1), str(tmp_path / "out"), "csv")
    with open(glob.glob(str(tmp_path / "out" / "*.csv"))[0], newline="") as f:
        assert list(csv.reader(f)) == [["n", "t"], ["1", text]]
