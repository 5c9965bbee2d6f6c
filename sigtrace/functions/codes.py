"""Code dictionaries as small dimension tables.

Each table is a fixed-size lookup (at most a few dozen rows), so broadcasting it is
safe at any data scale.  The same rows render as a ``VALUES`` list for the DuckDB
oracle, so both engines join against identical data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES (3GPP code tables and names; must equal the reference's output)
# ---------------------------------------------------------------------------

# S1AP procedure codes, 3GPP TS 36.413.
S1AP_PROCEDURES = {
    "0": "HandoverPreparation", "1": "HandoverResourceAllocation", "2": "HandoverNotification",
    "3": "PathSwitchRequest", "4": "HandoverCancel", "5": "E-RABSetup", "6": "E-RABModify",
    "7": "E-RABRelease", "8": "E-RABReleaseIndication", "9": "InitialContextSetup", "10": "Paging",
    "11": "DownlinkNASTransport", "12": "InitialUEMessage", "13": "UplinkNASTransport", "14": "Reset",
    "15": "ErrorIndication", "16": "NASNonDeliveryIndication", "17": "S1Setup",
    "18": "UEContextReleaseRequest", "19": "DownlinkS1cdma2000tunnelling",
    "20": "UplinkS1cdma2000tunnelling", "21": "UEContextModification",
    "22": "UECapabilityInfoIndication", "23": "UEContextRelease", "24": "eNBStatusTransfer",
    "25": "MMEStatusTransfer", "26": "DeactivateTrace", "27": "TraceStart",
    "28": "TraceFailureIndication", "29": "ENBConfigurationUpdate", "30": "MMEConfigurationUpdate",
    "31": "LocationReportingControl", "32": "LocationReportingFailureIndication",
    "33": "LocationReport", "34": "OverloadStart", "35": "OverloadStop", "36": "WriteReplaceWarning",
    "37": "eNBDirectInformationTransfer", "38": "MMEDirectInformationTransfer",
    "39": "PrivateMessage", "40": "eNBConfigurationTransfer", "41": "MMEConfigurationTransfer",
    "42": "CellTrafficTrace",
}

# NGAP procedure codes, 3GPP TS 38.413.
NGAP_PROCEDURES = {
    "0": "AMFConfigurationUpdate", "1": "AMFStatusIndication", "2": "CellTrafficTrace",
    "3": "DeactivateTrace", "4": "DownlinkNASTransport", "5": "DownlinkNonUEAssociatedNRPPaTransport",
    "6": "DownlinkRANConfigurationTransfer", "7": "DownlinkRANStatusTransfer",
    "8": "DownlinkUEAssociatedNRPPaTransport", "9": "ErrorIndication", "10": "HandoverCancel",
    "11": "HandoverNotification", "12": "HandoverPreparation", "13": "HandoverResourceAllocation",
    "14": "InitialContextSetup", "15": "InitialUEMessage", "16": "LocationReportingControl",
    "17": "LocationReportingFailureIndication", "18": "LocationReport",
    "19": "NASNonDeliveryIndication", "20": "NGReset", "21": "NGSetup", "22": "OverloadStart",
    "23": "OverloadStop", "24": "Paging", "25": "PathSwitchRequest", "26": "PDUSessionResourceModify",
    "27": "PDUSessionResourceModifyIndication", "28": "PDUSessionResourceRelease",
    "29": "PDUSessionResourceSetup", "30": "PDUSessionResourceNotify", "31": "PrivateMessage",
    "32": "PWSCancel", "33": "PWSFailureIndication", "34": "PWSRestartIndication",
    "35": "RANConfigurationUpdate", "36": "RerouteNASRequest", "37": "RRCInactiveTransitionReport",
    "38": "TraceFailureIndication", "39": "TraceStart", "40": "UEContextModification",
    "41": "UEContextRelease", "42": "UEContextReleaseRequest", "43": "UERadioCapabilityCheck",
    "44": "UERadioCapabilityInfoIndication", "45": "UETNLABindingRelease", "46": "UplinkNASTransport",
    "47": "UplinkNonUEAssociatedNRPPaTransport", "48": "UplinkRANConfigurationTransfer",
    "49": "UplinkRANStatusTransfer", "50": "UplinkUEAssociatedNRPPaTransport",
    "51": "WriteReplaceWarning",
}

# NAS-5GS mobility-management message types, 3GPP TS 24.501 (decimal codes).
NAS_5GS_MM = {
    "65": "Registration request", "66": "Registration accept", "67": "Registration complete",
    "68": "Registration reject", "69": "Deregistration request (UE originating)",
    "70": "Deregistration accept (UE originating)", "71": "Deregistration request (UE terminated)",
    "72": "Deregistration accept (UE terminated)", "76": "Service request", "77": "Service reject",
    "78": "Service accept", "79": "Configuration update command", "80": "Configuration update complete",
    "81": "Authentication request", "82": "Authentication response", "83": "Authentication reject",
    "84": "Authentication failure", "85": "Authentication result", "86": "Identity request",
    "87": "Identity response", "93": "Security mode command", "94": "Security mode complete",
    "95": "Security mode reject", "100": "5GMM status", "101": "Notification",
    "102": "Notification response", "103": "UL NAS transport", "104": "DL NAS transport",
}

# NAS-5GS session-management message types, 3GPP TS 24.501 (decimal codes).
NAS_5GS_SM = {
    "193": "PDU session establishment request", "194": "PDU session establishment accept",
    "195": "PDU session establishment reject", "197": "PDU session authentication command",
    "198": "PDU session authentication complete", "199": "PDU session authentication result",
    "201": "PDU session modification request", "202": "PDU session modification reject",
    "203": "PDU session modification command", "204": "PDU session modification complete",
    "205": "PDU session modification command reject", "209": "PDU session release request",
    "210": "PDU session release reject", "211": "PDU session release command",
    "212": "PDU session release complete", "214": "5GSM status",
}

# NGAP cause groups (TS 38.413): group code -> name of the value field.
CAUSE_GROUPS = {"0": "radioNetwork", "1": "transport", "2": "nas", "3": "protocol", "4": "misc"}

# NGAP cause values per group (TS 38.413).
CAUSE_RADIO_NETWORK = {
    "0": "unspecified", "1": "txnrelocoverall-expiry", "2": "successful-handover",
    "3": "release-due-to-ngran-generated-reason", "4": "release-due-to-5gc-generated-reason",
    "5": "handover-cancelled", "6": "partial-handover",
    "7": "ho-failure-in-target-5GC-ngran-node-or-target-system", "8": "ho-target-not-allowed",
    "9": "tngrelocoverall-expiry", "10": "tngrelocprep-expiry", "11": "cell-not-available",
    "12": "unknown-targetID", "13": "no-radio-resources-available-in-target-cell",
    "14": "unknown-local-UE-NGAP-ID", "15": "inconsistent-remote-UE-NGAP-ID",
    "16": "handover-desirable-for-radio-reason", "17": "time-critical-handover",
    "18": "resource-optimisation-handover", "19": "reduce-load-in-serving-cell",
    "20": "user-inactivity", "21": "radio-connection-with-ue-lost",
    "22": "radio-resources-not-available", "23": "invalid-qos-combination",
    "24": "failure-in-radio-interface-procedure", "25": "interaction-with-other-procedure",
    "26": "unknown-PDU-session-ID", "27": "unkown-qos-flow-ID",
    "28": "multiple-PDU-session-ID-instances", "29": "multiple-qos-flow-ID-instances",
    "30": "encryption-and-or-integrity-protection-algorithms-not-supported",
    "31": "ng-intra-system-handover-triggered", "32": "ng-inter-system-handover-triggered",
    "33": "xn-handover-triggered", "34": "not-supported-5QI-value", "35": "ue-context-transfer",
    "36": "ims-voice-eps-fallback-or-rat-fallback-triggered",
    "37": "up-integrity-protection-not-possible", "38": "up-confidentiality-protection-not-possible",
    "39": "slice-not-supported", "40": "ue-in-rrc-inactive-state-not-reachable", "41": "redirection",
    "42": "resources-not-available-for-the-slice", "43": "ue-max-integrity-protected-data-rate-reason",
    "44": "release-due-to-cn-detected-mobility", "45": "n26-interface-not-available",
    "46": "release-due-to-pre-emption",
}
CAUSE_TRANSPORT = {"0": "transport-resource-unavailable", "1": "unspecified"}
CAUSE_NAS = {"0": "normal-release", "1": "authentication-failure", "2": "deregister", "3": "unspecified"}
CAUSE_PROTOCOL = {
    "0": "transfer-syntax-error", "1": "abstract-syntax-error-reject",
    "2": "abstract-syntax-error-ignore-and-notify", "3": "message-not-compatible-with-receiver-state",
    "4": "semantic-error", "5": "abstract-syntax-error-falsely-constructed-message", "6": "unspecified",
}
CAUSE_MISC = {
    "0": "control-processing-overload", "1": "not-enough-user-plane-processing-resources",
    "2": "hardware-failure", "3": "om-intervention", "4": "unknown-PLMN", "5": "unspecified",
}
CAUSE_VALUES = {"0": CAUSE_RADIO_NETWORK, "1": CAUSE_TRANSPORT, "2": CAUSE_NAS, "3": CAUSE_PROTOCOL, "4": CAUSE_MISC}

# Keyword classification of a cause text (K3: a fixed order instead of set order).
ABNORMAL_KEYWORDS = ["redirection", "redirect", "unsuccessful", "failure", "triggered", "timeout"]
NORMAL_KEYWORDS = ["inactivity", "mobility", "handover", "deregister", "normal"]
# Words that mark a field value as a textual cause (last-resort cause lookup).
CAUSE_HINT_WORDS = ["inactivity", "mobility", "handover", "redirect", "failure", "triggered", "timeout", "deregister"]

# 3GPP cause classification as published in the reference's cause knowledge table.
STANDARD_NORMAL_CAUSES = [
    "user-inactivity", "successful-handover", "release-due-to-cn-detected-mobility",
    "ng-intra-system-handover-triggered", "ng-inter-system-handover-triggered", "xn-handover-triggered",
    "release-due-to-ngran-generated-reason", "release-due-to-5gc-generated-reason",
    "normal-release", "deregister", "detach",
]
STANDARD_ABNORMAL_CAUSES = [
    "redirection", "radio-connection-with-ue-lost", "handover-cancelled", "partial-handover",
    "ho-failure-in-target-5GC-ngran-node-or-target-system", "ho-target-not-allowed",
    "no-radio-resources-available-in-target-cell", "cell-not-available",
    "failure-in-radio-interface-procedure", "authentication-failure", "transport-resource-unavailable",
    "transfer-syntax-error", "abstract-syntax-error-reject", "message-not-compatible-with-receiver-state",
    "control-processing-overload", "not-enough-user-plane-processing-resources", "hardware-failure",
]

# Handover outcome of radioNetwork cause values.
HO_FAILURE_CAUSES = ["5", "6", "7", "8"]
HO_SUCCESS_CAUSES = ["2", "16", "17", "18", "31", "32", "33"]

# Short cause names shown on call-flow steps (radioNetwork only; others print code-<n>).
STEP_CAUSE_NAMES = {
    "2": "successful-handover", "5": "handover-cancelled", "20": "user-inactivity",
    "31": "ng-intra-system-handover-triggered", "32": "ng-inter-system-handover-triggered",
}

# Interpretation notes per cause (fixed output text), first matching substring rule wins.
CAUSE_NOTES = [
    ("user-inactivity", "user-inactivity: UE became idle after inactivity timer expiry (normal behavior)"),
    ("deregister", "deregister: UE initiated detach/deregistration (user or device action)"),
    ("normal-release", "normal-release: Standard call/session termination procedure"),
    ("handover", "handover: UE moved to different cell/system (mobility procedure)"),
    ("radio-connection-with-ue-lost", "radio-connection-with-ue-lost: Radio link failure - possible coverage issue"),
    ("authentication-failure", "authentication-failure: Security authentication failed - check SIM/credentials"),
    ("failure", "{cause}: Indicates a failure condition requiring investigation"),
]
HO_FAILURE_NOTES = [
    ("cancelled", "handover-cancelled: Handover procedure was cancelled before completion."),
    ("partial", "partial-handover: Only some bearers/PDU sessions were handed over."),
    ("ho-failure", "ho-failure-in-target: Handover failed at the target gNB or core network."),
    ("ho-target-not-allowed", "ho-target-not-allowed: Handover to target cell is not permitted."),
]

# Possible reasons shown with each handover failure note (fixed output text), by the same patterns.
HO_FAILURE_REASONS = [
    ("cancelled", "Network congestion, target cell unavailable, UE moved out of range."),
    ("partial", "Target cell lacks resources for all sessions, QoS constraints."),
    ("ho-failure", "Target cell overload, configuration mismatch, X2/Xn interface issues."),
    ("ho-target-not-allowed", "Access restrictions, roaming policies, cell barring."),
]

# Why a RAN UE NGAP id changed, by the message type that carries the new id.
RAN_CHANGE_REASONS = {
    "HandoverResourceAllocation": "Target gNB assigns new RAN-UE-NGAP-ID after handover request",
    "HandoverNotification": "Handover completed, UE now using target gNB ID",
    "PathSwitchRequest": "Path switch after handover, new gNB identifier",
    "InitialContextSetup": "New context established with new RAN-UE-NGAP-ID",
}
RAN_CHANGE_DEFAULT_REASON = "New RAN-UE-NGAP-ID assigned during mobility procedure"

# Message-type synonyms: spelling -> (canonical name, message_type value), in the
# reference's insertion order; a spelling listed twice keeps its later value.
MESSAGE_SYNONYMS = [
    ("s1 setup request", "S1 Setup Request", "18"), ("s1setuprequest", "S1 Setup Request", "18"),
    ("s1 setup response", "S1 Setup Response", "17"), ("s1setupresponse", "S1 Setup Response", "17"),
    ("initial context setup request", "Initial Context Setup Request", "9"),
    ("initialcontextsetuprequest", "Initial Context Setup Request", "9"),
    ("initial context setup response", "Initial Context Setup Response", "10"),
    ("initialcontextsetupresponse", "Initial Context Setup Response", "10"),
    ("ue context release command", "UE Context Release Command", "23"),
    ("uecontextreleasecommand", "UE Context Release Command", "23"),
    ("ue context release complete", "UE Context Release Complete", "24"),
    ("uecontextreleasecomplete", "UE Context Release Complete", "24"),
    ("mme configuration update", "MME Configuration Update", "30"),
    ("mmeconfigurationupdate", "MME Configuration Update", "30"),
    ("handover request", "Handover Request", "0"), ("handoverrequest", "Handover Request", "0"),
    ("handover command", "Handover Command", "1"), ("handovercommand", "Handover Command", "1"),
    ("handover failure", "Handover Failure", "4"), ("handoverfailure", "Handover Failure", "4"),
    ("handover required", "Handover Required", "HandoverPreparation"),
    ("handoverrequired", "Handover Required", "HandoverPreparation"),
    ("handoverRequired", "Handover Required", "HandoverPreparation"),
    ("handover preparation", "Handover Preparation", "HandoverPreparation"),
    ("handoverpreparation", "Handover Preparation", "HandoverPreparation"),
    ("HandoverPreparation", "Handover Preparation", "HandoverPreparation"),
    ("handover resource allocation", "Handover Resource Allocation", "HandoverResourceAllocation"),
    ("handoverresourceallocation", "Handover Resource Allocation", "HandoverResourceAllocation"),
    ("HandoverResourceAllocation", "Handover Resource Allocation", "HandoverResourceAllocation"),
    ("attach request", "Attach Request", "65"), ("attachrequest", "Attach Request", "65"),
    ("attach accept", "Attach Accept", "66"), ("attachaccept", "Attach Accept", "66"),
    ("attach reject", "Attach Reject", "67"), ("attachreject", "Attach Reject", "67"),
    ("detach request", "Detach Request", "69"), ("detachrequest", "Detach Request", "69"),
    ("detach accept", "Detach Accept", "70"), ("detachaccept", "Detach Accept", "70"),
    ("tracking area update request", "Tracking Area Update Request", "72"),
    ("trackingareaupdaterequest", "Tracking Area Update Request", "72"),
    ("tracking area update accept", "Tracking Area Update Accept", "73"),
    ("trackingareaupdateaccept", "Tracking Area Update Accept", "73"),
    ("tracking area update reject", "Tracking Area Update Reject", "74"),
    ("trackingareaupdatereject", "Tracking Area Update Reject", "74"),
    ("authentication request", "Authentication Request", "82"),
    ("authenticationrequest", "Authentication Request", "82"),
    ("authentication response", "Authentication Response", "83"),
    ("authenticationresponse", "Authentication Response", "83"),
    ("authentication failure", "Authentication Failure", "92"),
    ("authenticationfailure", "Authentication Failure", "92"),
    ("security mode command", "Security Mode Command", "93"), ("securitymodecommand", "Security Mode Command", "93"),
    ("security mode complete", "Security Mode Complete", "94"), ("securitymodecomplete", "Security Mode Complete", "94"),
    ("security mode reject", "Security Mode Reject", "95"), ("securitymodereject", "Security Mode Reject", "95"),
    ("rrc connection request", "RRC Connection Request", "rrcConnectionRequest"),
    ("rrcconnectionrequest", "RRC Connection Request", "rrcConnectionRequest"),
    ("rrc connection setup", "RRC Connection Setup", "rrcConnectionSetup"),
    ("rrcconnectionsetup", "RRC Connection Setup", "rrcConnectionSetup"),
    ("rrc connection setup complete", "RRC Connection Setup Complete", "rrcConnectionSetupComplete"),
    ("rrcconnectionsetupcomplete", "RRC Connection Setup Complete", "rrcConnectionSetupComplete"),
    ("rrc connection release", "RRC Connection Release", "rrcConnectionRelease"),
    ("rrcconnectionrelease", "RRC Connection Release", "rrcConnectionRelease"),
    ("rrc connection reconfiguration", "RRC Connection Reconfiguration", "rrcConnectionReconfiguration"),
    ("rrcconnectionreconfiguration", "RRC Connection Reconfiguration", "rrcConnectionReconfiguration"),
    ("rrc connection reconfiguration complete", "RRC Connection Reconfiguration Complete", "rrcConnectionReconfigurationComplete"),
    ("rrcconnectionreconfigurationcomplete", "RRC Connection Reconfiguration Complete", "rrcConnectionReconfigurationComplete"),
    ("measurement report", "Measurement Report", "measurementReport"),
    ("measurementreport", "Measurement Report", "measurementReport"),
    ("security mode command", "Security Mode Command", "securityModeCommand"),
    ("securitymodecommand", "Security Mode Command", "securityModeCommand"),
    ("security mode complete", "Security Mode Complete", "securityModeComplete"),
    ("securitymodecomplete", "Security Mode Complete", "securityModeComplete"),
    ("system information", "System Information", "systemInformation"),
    ("systeminformation", "System Information", "systemInformation"),
    ("paging", "Paging", "paging"),
]


# ---------------------------------------------------------------------------
# Dimension tables built from the fixed values
# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class Dim:
    name: str
    columns: tuple[str, ...]
    rows: tuple[tuple, ...]

    def df(self, spark: SparkSession) -> DataFrame:
        """Broadcast-hinted DataFrame; size is fixed by the code table, not the data."""
        schema = ", ".join(f"{c} {_sql_type(v)}" for c, v in zip(self.columns, self.rows[0]))
        return F.broadcast(spark.createDataFrame(list(self.rows), schema))

    def sql(self) -> str:
        """``(VALUES ...) AS name(cols)`` for embedding in the oracle SQL."""
        vals = ", ".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in self.rows)
        return f"(VALUES {vals}) AS {self.name}({', '.join(self.columns)})"


def _sql_type(v) -> str:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "bigint"
    return "string"


def _lit(v) -> str:
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int):
        return f"CAST({v} AS BIGINT)"
    return "'" + str(v).replace("'", "''") + "'"


def _dedup_last(rows):
    """Keep the last value of a repeated key, at the position of its first insertion (dict semantics)."""
    order: dict = {}
    for r in rows:
        order.setdefault(r[0], None)
        order[r[0]] = r
    return list(order.values())


DIM_PROCEDURE = Dim(
    "dim_procedure", ("protocol", "code", "name"),
    tuple([("S1AP", k, v) for k, v in S1AP_PROCEDURES.items()] + [("NGAP", k, v) for k, v in NGAP_PROCEDURES.items()]),
)
DIM_NAS = Dim(
    "dim_nas", ("kind", "code", "name"),
    tuple([("MM", k, v) for k, v in NAS_5GS_MM.items()] + [("SM", k, v) for k, v in NAS_5GS_SM.items()]),
)
DIM_CAUSE = Dim(
    "dim_cause", ("grp", "value", "name"),
    tuple((g, k, v) for g, tbl in CAUSE_VALUES.items() for k, v in tbl.items()),
)
DIM_CAUSE_CLASS = Dim(
    "dim_cause_class", ("cause_name", "std_normal"),
    tuple([(c, True) for c in STANDARD_NORMAL_CAUSES] + [(c, False) for c in STANDARD_ABNORMAL_CAUSES]),
)
DIM_HO_CAUSE = Dim(
    "dim_ho_cause", ("value", "outcome"),
    tuple([(c, "failure") for c in HO_FAILURE_CAUSES] + [(c, "success") for c in HO_SUCCESS_CAUSES]),
)
DIM_MESSAGE_SYNONYM = Dim(
    "dim_message_synonym", ("ord", "spelling", "canonical", "value"),
    tuple((i, s, c, v) for i, (s, c, v) in enumerate(_dedup_last(MESSAGE_SYNONYMS))),
)
DIM_RAN_CHANGE_REASON = Dim(
    "dim_ran_change_reason", ("message_type", "reason"), tuple(RAN_CHANGE_REASONS.items()),
)
