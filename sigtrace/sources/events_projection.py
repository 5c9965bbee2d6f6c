"""The ``packets`` table as a deterministic projection of the driver's ``events`` table.

The driver ships no packet capture, so every query that is checked against DuckDB
starts from this projection (see FIXTURES.md §2).  The same SQL text runs in both
engines; only the two time placeholders differ.  5G users (``user_id % 3 <> 0``)
produce NGAP packets, LTE users S1AP / X2AP / RRC packets.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

PROJECTION_SQL = """
WITH b AS (
 SELECT event_id AS e, user_id AS u, CAST(regexp_extract(props,'([0-9]+)',1) AS INT) AS k, value AS v, ts, event_type FROM {EVENTS}),
c AS (SELECT *, CASE WHEN u % 3 = 0 THEN '4g' ELSE '5g' END AS rat,
 CASE WHEN u % 3 <> 0 THEN 'NGAP' WHEN k < 50 THEN 'S1AP' WHEN k < 65 THEN 'X2AP' ELSE 'RRC' END AS protocol,
 CASE WHEN u % 3 <> 0 THEN CASE WHEN k<10 THEN '15' WHEN k<20 THEN '14' WHEN k<30 THEN '4' WHEN k<40 THEN '46' WHEN k<50 THEN '29' WHEN k<60 THEN '12' WHEN k<70 THEN '13' WHEN k<75 THEN '11' WHEN k<80 THEN '25' WHEN k<90 THEN '41' ELSE '42' END
      WHEN k < 50 THEN CASE WHEN k<10 THEN '0' WHEN k<20 THEN '1' WHEN k<30 THEN '9' WHEN k<40 THEN '12' ELSE '23' END
      WHEN k < 65 THEN CASE WHEN k<55 THEN 'HandoverRequest' WHEN k<60 THEN 'SNStatusTransfer' ELSE 'UEContextRelease' END
      ELSE CASE WHEN k<75 THEN 'rrcConnectionSetupComplete' WHEN k<90 THEN 'measurementReport' ELSE 'systemInformation' END END AS code,
 CAST(u*100 + FLOOR(k/25) AS BIGINT) AS ran, u + 1000 AS amf,
 CASE WHEN e % 2 = 0 THEN 0 ELSE CAST(FLOOR(e/2) AS BIGINT) % 5 END AS g
 FROM b),
d AS (SELECT *,
 CASE WHEN protocol='NGAP' THEN concat('{"ngap.ngap.procedureCode": "',code,'", "ngap.ngap.RAN_UE_NGAP_ID": "',CAST(ran AS VARCHAR(20)),'"',
   CASE WHEN code<>'15' THEN concat(', "ngap.ngap.AMF_UE_NGAP_ID": "',CAST(amf AS VARCHAR(20)),'"') ELSE '' END,
   CASE WHEN code='29' THEN concat(', "ngap.ngap.pDUSessionID": "',CAST(1+k%3 AS VARCHAR(20)),'", "ngap.nas-5gs.sm.pdu_addr_inf_ipv4": "10.0.',CAST(u%250 AS VARCHAR(20)),'.',CAST(k+1 AS VARCHAR(20)),'"') ELSE '' END,
   CASE WHEN code='12' THEN ', "ngap.ngap.HandoverRequired_element": ""' ELSE '' END,
   CASE WHEN code IN ('4','46') THEN concat(', "ngap.nas-5gs.mm.message_type": "',CASE k%4 WHEN 0 THEN '0x41' WHEN 1 THEN '0x42' WHEN 2 THEN '0x56' ELSE '0x5d' END,'"') ELSE '' END,
   CASE WHEN code IN ('41','42') THEN concat(CASE code WHEN '41' THEN ', "ngap.ngap.UEContextReleaseCommand_element": ""' ELSE ', "ngap.ngap.UEContextReleaseRequest_element": ""' END,
     ', "ngap.ngap.Cause": "',CAST(g AS VARCHAR(20)),'", "ngap.ngap.',CASE g WHEN 0 THEN 'radioNetwork' WHEN 1 THEN 'transport' WHEN 2 THEN 'nas' WHEN 3 THEN 'protocol' ELSE 'misc' END,'": "',
     CAST(CAST(FLOOR(v) AS BIGINT) % (CASE g WHEN 0 THEN 47 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 7 ELSE 6 END) AS VARCHAR(20)),'"') ELSE '' END,
   ', "sctp.sctp.srcport": "',CASE WHEN code IN ('4','14','29','41') THEN '38412' ELSE '45000' END,'"}')
 WHEN protocol='S1AP' THEN concat('{"s1ap.s1ap.procedureCode": "',code,'", "s1ap.s1ap.ENB_UE_S1AP_ID": "',CAST(u AS VARCHAR(20)),'"',
   CASE WHEN code='12' THEN concat(', "s1ap.nas-eps.emm.m_tmsi": "',CAST(400000+CAST(FLOOR(u/6) AS BIGINT) AS VARCHAR(20)),'"') ELSE concat(', "s1ap.s1ap.MME_UE_S1AP_ID": "',CAST(u+60000 AS VARCHAR(20)),'"') END,
   CASE WHEN code='9' THEN concat(', "s1ap.nas-eps.esm.pdn_ipv4": "10.1.',CAST(u%250 AS VARCHAR(20)),'.',CAST(k+1 AS VARCHAR(20)),'"') ELSE '' END,
   CASE WHEN code='0' THEN ', "s1ap.s1ap.HandoverRequired_element": ""' ELSE '' END,'}')
 WHEN protocol='X2AP' THEN concat('{"x2ap.x2ap.Old_ENB_UE_X2AP_ID": "',CAST(u AS VARCHAR(20)),'"}')
 ELSE concat('{"rlc_lte.rlc-lte.ueid": "',CAST(u+300 AS VARCHAR(20)),'"',
   CASE code WHEN 'rrcConnectionSetupComplete' THEN concat(', "rlc_lte.nas-eps.emm.m_tmsi": "',CAST(400000+CAST(FLOOR(u/6) AS BIGINT) AS VARCHAR(20)),'"')
   WHEN 'measurementReport' THEN concat(', "rlc_lte.lte-rrc.measResultPCell_element": "", "rlc_lte.lte-rrc.rsrpResult": "',CAST(k AS VARCHAR(20)),'", "rlc_lte.lte-rrc.rsrqResult": "',CAST(k%40 AS VARCHAR(20)),'"',
      CASE WHEN e%2=0 THEN concat(', "rlc_lte.lte-rrc.rsrpResult__context=pcell": "',CAST(k-5 AS VARCHAR(20)),'", "rlc_lte.lte-rrc.rsrqResult__context=pcell": "',CAST(k%35 AS VARCHAR(20)),'"') ELSE '' END)
   ELSE ', "rlc_lte.lte-rrc.sib3_element": "", "rlc_lte.lte-rrc.q_RxLevMin": "-62"' END,'}') END AS protocol_fields_json FROM c)
SELECT e + 1 AS packet_number, {EPOCH} AS timestamp, {ISO} AS timestamp_iso, date_trunc('hour', ts) AS timestamp_hour,
 CAST(60 + k AS INT) AS length, protocol,
 CASE WHEN protocol='NGAP' THEN CASE code WHEN '15' THEN 'InitialUEMessage' WHEN '14' THEN 'InitialContextSetup' WHEN '4' THEN 'DownlinkNASTransport' WHEN '46' THEN 'UplinkNASTransport' WHEN '29' THEN 'PDUSessionResourceSetup' WHEN '12' THEN 'HandoverPreparation' WHEN '13' THEN 'HandoverResourceAllocation' WHEN '11' THEN 'HandoverNotification' WHEN '25' THEN 'PathSwitchRequest' WHEN '41' THEN 'UEContextRelease' ELSE 'UEContextReleaseRequest' END
      WHEN protocol='S1AP' THEN CASE code WHEN '0' THEN 'HandoverPreparation' WHEN '1' THEN 'HandoverResourceAllocation' WHEN '9' THEN 'InitialContextSetup' WHEN '12' THEN 'InitialUEMessage' ELSE 'UEContextRelease' END
      ELSE code END AS message_type,
 CASE protocol WHEN 'NGAP' THEN 'N2' WHEN 'S1AP' THEN 'S1-MME' WHEN 'X2AP' THEN 'X2' ELSE 'Uu' END AS interface,
 CASE WHEN protocol='RRC' THEN CASE WHEN code='systemInformation' THEN 'DL' ELSE 'UL' END END AS direction,
 CASE protocol WHEN 'NGAP' THEN CAST(ran AS VARCHAR(20)) WHEN 'S1AP' THEN CAST(u AS VARCHAR(20)) END AS ue_id,
 concat('10.2.0.',CAST(u%250 AS VARCHAR(20))) AS source_ip, '10.3.0.1' AS destination_ip,
 CASE WHEN protocol IN ('NGAP','S1AP','X2AP') THEN 38412 END AS destination_port, protocol_fields_json
FROM d
"""

SPARK_PLACEHOLDERS = {
    "{EPOCH}": "CAST(unix_micros(CAST(ts AS TIMESTAMP))/1000000.0D AS DOUBLE)",
    "{ISO}": "date_format(ts,\"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")",
}
DUCKDB_PLACEHOLDERS = {
    "{EPOCH}": "epoch_us(ts)/1000000.0",
    "{ISO}": "strftime(ts,'%Y-%m-%dT%H:%M:%S.%f')",
}


def _fill(sql: str, values: dict[str, str]) -> str:
    for k, v in values.items():
        sql = sql.replace(k, v)
    return sql


def duckdb_packets_sql(events: str = "events") -> str:
    """Projection text for DuckDB, reading the pre-registered ``events`` view."""
    return _fill(PROJECTION_SQL, {**DUCKDB_PLACEHOLDERS, "{EVENTS}": events})


def packets_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``packets`` DataFrame projected from ``{sf_dir}/events.parquet``.

    Map-only: one scan of events, no shuffle; Spark prunes to the 6 columns used.
    """
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    view = "sigtrace_events_" + hashlib.sha1(path.encode()).hexdigest()[:10]
    events = spark.read.parquet(path)
    events.createOrReplaceTempView(view)
    return spark.sql(_fill(PROJECTION_SQL, {**SPARK_PLACEHOLDERS, "{EVENTS}": view}))
