"""PDML (Wireshark XML) source: one row per ``<packet>``.

Spark's text source splits the files on the record separator ``</packet>``, so a
multi-gigabyte capture becomes many input splits read in parallel (a record that
straddles a split boundary is handled by the line reader).  Each record is read by
an event-driven XML parser with a stack of open measurement scopes (no tree is
built), straight into Arrow arrays, which keeps the field rules of the reference:
value = ``show`` else ``value``; the last occurrence of a field wins; RSRP / RSRQ keep
their first value plus ``__context=pcell`` / ``__context=neigh[i]`` keys.  Packets
without a ``frame`` protocol or that fail to parse go to a rejects DataFrame instead
of being dropped silently.  Every packet and reject carries its ``capture``, the
file it was read from unless the caller names it.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigtrace.sources.packets import with_capture
from sigtrace.sources.schema import LAYERED_PACKET

RECORD_SEPARATOR = "</packet>"
# FIXED VALUES: RRC measurement fields and the PDML elements that scope them.
MEASUREMENT_FIELDS = {"lte-rrc.rsrpResult", "lte-rrc.rsrqResult"}
PCELL_ELEMENT = "lte-rrc.measResultPCell_element"
NEIGHBOUR_ELEMENTS = ["lte-rrc.MeasResultEUTRA_element", "lte-rrc.measResultListEUTRA"]
# FIXED VALUES: fields of a packet's head, by the protocol they are taken from.
HEAD_FIELDS = {
    "frame": ("frame.number", "frame.time_epoch", "frame.len"),
    "ip": ("ip.src", "ip.dst"),
    "tcp": ("tcp.srcport", "tcp.dstport"),
    "udp": ("udp.srcport", "udp.dstport"),
    "sctp": ("sctp.srcport", "sctp.dstport"),
}
PORTS = ("tcp", "udp", "sctp")

PARSED = T.StructType(
    [T.StructField("capture", T.StringType(), True), *LAYERED_PACKET.fields, T.StructField("_error", T.StringType(), True), T.StructField("_record", T.StringType(), True)]
)
#: Records parsed into one Arrow batch.
BATCH = 1_000


class PacketReader:
    """Reads one ``<packet>`` record at a time: its protocols with their field maps, and the fields of its head."""

    def read(self, xml_text: str) -> tuple[list[tuple[str, str, dict[str, str]]], dict[str, dict[str, str]]]:
        """``[(name, shown name, fields)]`` and ``{protocol: {head field: first value}}``; raises on malformed XML."""
        self.layers: list[tuple[str, str, dict[str, str]]] = []
        self.heads: dict[str, dict[str, str]] = {}
        self.fields: dict[str, str] | None = None
        self.first: dict[str, str] | None = None  # head fields of the protocol, as far as they have been seen
        self.wanted: tuple[str, ...] = ()
        self.depth = self.pcell = self.neighbour = self.neighbours = 0
        self.scopes: list[int] = []
        parser = expat.ParserCreate()
        parser.buffer_text = True
        parser.StartElementHandler = self._start
        parser.EndElementHandler = self._end
        parser.Parse(xml_text, True)
        return self.layers, self.heads

    def _start(self, tag: str, attributes: dict[str, str]) -> None:
        self.depth += 1
        if tag == "field" and self.fields is not None:
            name = attributes.get("name", "")
            scope = 0
            if name:
                value = attributes.get("show") or attributes.get("value", "")
                if name in self.wanted and name not in self.first:
                    self.first[name] = value
                if name in MEASUREMENT_FIELDS:
                    self._measurement(name, value)
                else:
                    self.fields[name] = value
                    if name == PCELL_ELEMENT:
                        scope, self.pcell = 1, self.pcell + 1
                    elif name in NEIGHBOUR_ELEMENTS:
                        scope, self.neighbour = 2, self.neighbour + 1
            self.scopes.append(scope)
        elif tag == "proto" and self.depth == 2:
            name = attributes.get("name", "")
            self.fields = {}
            self.layers.append((name, attributes.get("showname", name), self.fields))
            self.neighbours = 0
            self.wanted = HEAD_FIELDS.get(name, ()) if name not in self.heads else ()  # the first protocol of a name counts
            self.first = self.heads.setdefault(name, {}) if self.wanted else {}

    def _measurement(self, name: str, value: str) -> None:
        self.fields.setdefault(name, value)
        if self.pcell:
            self.fields.setdefault(f"{name}__context=pcell", value)
        elif self.neighbour:
            self.fields[f"{name}__context=neigh[{self.neighbours}]"] = value
            if name == "lte-rrc.rsrqResult":
                self.neighbours += 1

    def _end(self, tag: str) -> None:
        self.depth -= 1
        if tag == "field" and self.fields is not None:
            scope = self.scopes.pop()
            if scope == 1:
                self.pcell -= 1
            elif scope == 2:
                self.neighbour -= 1
        elif tag == "proto" and self.depth == 1:
            self.fields = None


def proto_fields(proto_xml: str) -> dict[str, str]:
    """A2: field map of one ``<proto>`` given as text."""
    return PacketReader().read(f"<packet>{proto_xml}</packet>")[0][0][2]


def _head(heads: dict[str, dict[str, str]]) -> dict:
    if "frame" not in heads:
        raise ValueError("packet has no frame protocol")
    frame, ip = heads["frame"], heads.get("ip", {})
    ts = float(frame.get("frame.time_epoch", "0"))
    ports = next((tp for tp in PORTS if tp in heads), None)
    port = lambda side: int(v) if ports and (v := heads[ports].get(f"{ports}.{side}")) else None
    return {
        "packet_number": int(frame.get("frame.number", "0")),
        "timestamp": ts,
        "timestamp_iso": _dt.datetime.fromtimestamp(ts, tz=_dt.timezone.utc).replace(tzinfo=None).isoformat(),
        "length": int(frame.get("frame.len", "0")),
        "source_ip": ip.get("ip.src") or None,
        "destination_ip": ip.get("ip.dst") or None,
        "source_port": port("srcport"),
        "destination_port": port("dstport"),
    }


def parse_packet(xml_text: str) -> dict:
    """One ``<packet>`` element -> row dict (raises on malformed XML or a missing frame)."""
    layers, heads = PacketReader().read(xml_text)
    return _head(heads) | {
        "protocol_stack": [name for name, _, _ in layers],
        "protocol_layers": [{"protocol_name": n, "protocol_display": d, "fields": f} for n, d, f in layers],
    }


class _Rows:
    """Arrow columns of parsed records; nested columns are flat lists with offsets."""

    PLAIN = {f.name: f.dataType for f in PARSED.fields if f.name not in ("protocol_stack", "protocol_layers")}
    KINDS = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}

    def __init__(self) -> None:
        self.plain: dict[str, list] = {name: [] for name in self.PLAIN}
        self.names, self.displays, self.keys, self.values = [], [], [], []
        self.field_ends, self.layer_ends, self.whole = [0], [0], []

    def add(self, capture: str | None, head: dict, layers: list | None, error: str | None = None, record: str | None = None) -> None:
        for name, held in self.plain.items():
            held.append(head.get(name))
        self.plain["capture"][-1], self.plain["_error"][-1], self.plain["_record"][-1] = capture, error, record
        for name, display, fields in layers or ():
            self.names.append(name)
            self.displays.append(display)
            self.keys.extend(fields)
            self.values.extend(fields.values())
            self.field_ends.append(len(self.keys))
        self.layer_ends.append(len(self.names))
        self.whole.append(layers is not None)

    def batch(self) -> pa.RecordBatch:
        mask = pa.array([not w for w in self.whole], pa.bool_())
        ends = pa.array(self.layer_ends, pa.int32())
        names = pa.array(self.names, pa.string())
        fields = pa.MapArray.from_arrays(pa.array(self.field_ends, pa.int32()), pa.array(self.keys, pa.string()), pa.array(self.values, pa.string()))
        layers = pa.StructArray.from_arrays([names, pa.array(self.displays, pa.string()), fields], ["protocol_name", "protocol_display", "fields"])
        columns = {n: pa.array(v, self.KINDS[self.PLAIN[n].simpleString()]) for n, v in self.plain.items()}
        columns["protocol_stack"] = pa.ListArray.from_arrays(ends, names, mask=mask)
        columns["protocol_layers"] = pa.ListArray.from_arrays(ends, layers, mask=mask)
        return pa.RecordBatch.from_arrays([columns[f.name] for f in PARSED.fields], PARSED.names)


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = PacketReader()
    for batch in batches:
        rows = _Rows()
        for rec, capture in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            start = -1 if rec is None else rec.find("<packet")
            if start < 0:
                continue  # prolog / trailer text between packets
            xml_text = rec[start:] + RECORD_SEPARATOR
            try:
                layers, heads = reader.read(xml_text)
                rows.add(capture, _head(heads), layers)
            except Exception as e:  # noqa: BLE001 - a bad packet becomes a reject row, whole
                rows.add(capture, {}, None, f"{type(e).__name__}: {e}", xml_text)
            if len(rows.whole) >= BATCH:
                yield rows.batch()
                rows = _Rows()
        yield rows.batch()


def parse_pdml_text(records: DataFrame) -> DataFrame:
    """Parse a DataFrame of ``value`` strings (one ``<packet>`` record each) and their ``capture``."""
    if "capture" not in records.columns:
        records = records.withColumn("capture", F.lit(None).cast("string"))
    return records.select("value", "capture").mapInArrow(_parse_batches, PARSED)


def read_pdml(spark: SparkSession, path: str | list[str], capture: Column | str | None = None) -> tuple[DataFrame, DataFrame]:
    """A1/A2: PDML file(s) -> (packets, rejects), each with its ``capture`` (see ``with_capture``)."""
    raw = spark.read.option("lineSep", RECORD_SEPARATOR).option("wholetext", "false").text(path)
    parsed = parse_pdml_text(with_capture(raw, capture))
    good = parsed.where(F.col("_error").isNull()).drop("_error", "_record")
    bad = parsed.where(F.col("_error").isNotNull()).select("capture", "_error", "_record")
    return good, bad


# ---------------------------------------------------------------------------
# PDML writer (used to turn a packets table into a capture-shaped file)
# ---------------------------------------------------------------------------
def _attr(c):
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), '"', "&quot;"), "<", "&lt;"), ">", "&gt;")


def to_pdml_records(layered: DataFrame) -> DataFrame:
    """Render layered packets as ``<packet>`` XML records (one string per packet), in Spark."""
    frame = F.concat(
        F.lit('<proto name="frame" showname="frame">'),
        F.lit('<field name="frame.number" show="'), F.col("packet_number").cast("string"), F.lit('"/>'),
        F.lit('<field name="frame.time_epoch" show="'), F.format_string("%.6f", F.col("timestamp")), F.lit('"/>'),
        F.lit('<field name="frame.len" show="'), F.coalesce(F.col("length").cast("string"), F.lit("0")), F.lit('"/>'),
        F.lit("</proto>"),
    )
    protos = F.array_join(
        F.transform(
            F.col("protocol_layers"),
            lambda l: F.concat(
                F.lit('<proto name="'), _attr(l["protocol_name"]), F.lit('" showname="'), _attr(l["protocol_display"]), F.lit('">'),
                F.array_join(
                    F.transform(
                        F.map_entries(l["fields"]),
                        lambda e: F.concat(F.lit('<field name="'), _attr(e["key"]), F.lit('" show="'), _attr(F.coalesce(e["value"], F.lit(""))), F.lit('"/>')),
                    ),
                    "",
                ),
                F.lit("</proto>"),
            ),
        ),
        "",
    )
    return layered.select(F.concat(F.lit("<packet>"), frame, protos, F.lit("</packet>")).alias("value"))
