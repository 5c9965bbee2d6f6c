"""JSONL source, normalisation, Parquet sink, loader and result writers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from sigtrace.functions.fields import capture_scope
from sigtrace.sources.schema import HOT_ALIASES, HOT_DIFFER, HOT_KEYS, JSONL_RECORD, LAYER

# Default protocols kept when filtering by stack (empty list = keep everything).
DEFAULT_PROTOCOLS = ["s1ap", "x2ap", "lte_rrc", "ngap", "f1ap", "nr-rrc"]


def source_file() -> Column:
    """What a reader takes for a packet's capture where nothing else is named: the file it was read from."""
    return F.col("_metadata.file_path")


def with_capture(df: DataFrame, capture: Column | str | None = None) -> DataFrame:
    """``value`` and ``capture`` of text records: an expression over the source's columns and metadata, or a fixed name."""
    capture = source_file() if capture is None else F.lit(capture) if isinstance(capture, str) else capture
    return df.select("value", capture.cast("string").alias("capture"))


def parse_jsonl_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Parse JSONL text lines (blank lines skipped); malformed lines keep their text in ``_corrupt``; ``capture`` goes along."""
    v = F.col(col)
    nonblank = lines.where(F.trim(v) != "")
    rec = F.from_json(v, JSONL_RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    own = [c for c in lines.columns if c == "capture"]
    return nonblank.select(*own, rec.alias("r")).select(*own, "r.*")


def read_jsonl(spark: SparkSession, path: str | list[str], capture: Column | str | None = None) -> tuple[DataFrame, DataFrame]:
    """A3: JSONL -> (packets, rejects).  Lines are read as text (split across tasks like
    any text file) and parsed with ``from_json``; blank lines are skipped and malformed
    lines become reject rows instead of failing the job.  Packets and rejects carry their ``capture``
    (see :func:`with_capture`)."""
    parsed = parse_jsonl_lines(with_capture(spark.read.text(path), capture))
    good = parsed.where(F.col("_corrupt").isNull()).drop("_corrupt")
    bad = parsed.where(F.col("_corrupt").isNotNull()).select("capture", F.col("_corrupt").alias("_record"))
    return good, bad


def normalize_packets(df: DataFrame) -> DataFrame:
    """A4: the ``packets`` table shape: numeric timestamp (unparsable -> NULL), hour
    floor in UTC, nested values as JSON text, native ``fields`` map and ``protocol_stack``, hot id columns; a
    ``capture`` goes along."""
    ts = F.col("timestamp").cast("string").try_cast("double")
    fields = F.col("protocol_fields")
    out = df.withColumn("timestamp", ts).withColumn(
        "timestamp_hour", F.date_trunc("hour", F.timestamp_seconds(F.when(F.isnan(ts), None).otherwise(ts)))
    )
    cols = [c for c in df.columns if c not in ("protocol_fields", "protocol_layers", "protocol_stack")]
    return out.select(
        *[c for c in cols if c != "timestamp"],
        "timestamp",
        "timestamp_hour",
        F.to_json(fields).alias("protocol_fields_json"),
        F.to_json("protocol_layers").alias("protocol_layers_json"),
        F.to_json("protocol_stack").alias("protocol_stack_json"),
        fields.alias("fields"),
        "protocol_stack",
        *hot_columns(fields),
    )


def hot_columns(fields: Column) -> list[Column]:
    """The identifiers of a packet's field map as plain columns, which filters can be pushed to."""
    # map lookups only: functions over arrays are interpreted, and cost more than the rest of the sink
    held = {n: F.coalesce(*[fields[k] for k in keys]) for n, keys in HOT_ALIASES.items()}
    differ = F.lit(False)
    for n, keys in HOT_ALIASES.items():
        for k in keys[1:]:
            differ = differ | F.coalesce(fields[k] != held[n], F.lit(False))
    one = [value.alias(n) for n, value in held.items()]
    return [*[fields[k].alias(n) for n, k in HOT_KEYS.items()], *one, differ.alias(HOT_DIFFER)]


def write_packets(
    df: DataFrame,
    path: str,
    mode: str = "overwrite",
    partition_by_date: bool = True,
    observation: Observation | None = None,
    layout: str = "rebalance",
    max_records_per_file: int = 5_000_000,
    derived: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """A5: Parquet sink (snappy, dictionary, statistics), partitioned by capture date.

    A ``capture`` column is stored with its packets: files hold a capture's packets together, so
    statistics prune by capture (a folder per capture would not do for many small ones).

    ``layout``:
    * ``"rebalance"`` (default) - a REBALANCE hint on date and capture: AQE sizes the write tasks,
      splitting a date that holds most packets into several tasks and merging small
      ones, so files are neither tiny nor skewed (one shuffle, input read once);
    * ``"range"`` - sampled range exchange on (date, packet_number) for globally ordered
      files (reads the input twice: once for the range bounds);
    * ``"none"`` - no shuffle, for captures already arriving in time order.
    Rows are sorted by packet number inside each file so min/max statistics prune.

    ``derived`` adds columns that follow from a row's others (a parsed map, hot columns) when the rows are in place, so
    that they are neither shuffled nor sorted; it must be a projection.
    """
    out = df
    own = capture_scope(df)
    writer_cols = []
    if partition_by_date:
        out = out.withColumn("capture_date", F.to_date("timestamp_hour"))
        writer_cols = ["capture_date"]
        if layout == "rebalance":
            out = out.hint("rebalance", "capture_date", *own)
        elif layout == "range":
            out = out.repartitionByRange("capture_date", *own, "packet_number")
        elif layout != "none":
            raise ValueError(f"unknown layout: {layout}")
        out = out.sortWithinPartitions("capture_date", *own, "packet_number")
    else:
        out = out.sortWithinPartitions(*own, "packet_number")
    if derived is not None:
        out = derived(out)
    if observation is not None:
        # observed after any range exchange: its sampling job does not run this node
        out = out.observe(observation, F.count(F.lit(1)).alias("n"))
    w = out.write.mode(mode).option("compression", "snappy").option("maxRecordsPerFile", max_records_per_file)
    for c in (*HOT_KEYS, *HOT_ALIASES):  # ids are scattered over the files: a Bloom filter skips what min/max cannot
        if c in out.columns:
            w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    if writer_cols:
        w = w.partitionBy(*writer_cols)
    w.parquet(path)


def load_packets(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One path, or several combined (UNION ALL by column name); a missing path is an error.

    ``capture`` is what was stored at ingest; a table without it is one capture, named after its path (a table's
    part files are none: how many there are says nothing about the packets)."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("no packet paths given")
    frames = [spark.read.parquet(p) for p in paths]
    frames = [f if capture_scope(f) else f.withColumn("capture", F.lit(p)) for f, p in zip(frames, paths)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def with_layers(df: DataFrame) -> DataFrame:
    """``protocol_layers`` and ``protocol_stack`` of a stored table, for the operators over layers."""
    if "protocol_layers" not in df.columns and "protocol_layers_json" in df.columns:
        df = df.withColumn("protocol_layers", F.from_json("protocol_layers_json", ArrayType(LAYER)))
    if "protocol_stack" not in df.columns and "protocol_stack_json" in df.columns:
        df = df.withColumn("protocol_stack", F.from_json("protocol_stack_json", "array<string>"))
    return df


def filter_by_protocol_stack(df: DataFrame, protocols: Sequence[str] | None = DEFAULT_PROTOCOLS) -> DataFrame:
    """Keep packets whose stack contains any of ``protocols`` (empty / None keeps all)."""
    if not protocols:
        return df
    df = with_layers(df)
    wanted = F.array(*[F.lit(p) for p in protocols])
    return df.where(F.coalesce(F.arrays_overlap(F.col("protocol_stack"), wanted), F.lit(False)))


def write_results(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite", pretty: bool = False) -> None:
    """Results as JSON (nulls kept; one compact line a row, or ``pretty`` and indented) or CSV with a header
    (RFC 4180 quoting, NULL as an empty field)."""
    if fmt == "json" and pretty:
        text = F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"pretty": "true", "ignoreNullFields": "false"})
        df.select(text.alias("value")).write.mode(mode).text(path)
    elif fmt == "json":
        df.write.mode(mode).option("ignoreNullFields", False).json(path)
    elif fmt == "csv":
        df.write.mode(mode).option("header", True).option("nullValue", "").option("emptyValue", "").option("escape", '"').csv(path)
    else:
        raise ValueError(f"unknown result format: {fmt}")


def parse_run_summary(
    packets: DataFrame, rejects: DataFrame, path: str, rejects_path: str | None = None, partition_by_date: bool = True
) -> dict:
    """A5 + A10: write the packets table (and the rejects) and report packets parsed,
    malformed records and output bytes.

    For frames that a caller already has; ``sources.ingest.ingest_run`` parses a capture once for both sinks.
    The counts are ``observe()`` metrics of the two write jobs (each reads its input once)
    and the byte count comes from the written files' metadata.
    """
    obs_p, obs_r = Observation("packets"), Observation("rejects")
    write_packets(packets, path, partition_by_date=partition_by_date, observation=obs_p)
    rejects_path = rejects_path or path.rstrip("/") + "_rejects"
    rejects.observe(obs_r, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(rejects_path)
    spark = packets.sparkSession
    files = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size").distinct()
    size = files.agg(F.sum("file_size").alias("b")).first()["b"]
    return {"packets": obs_p.get["n"], "malformed": obs_r.get["n"], "output_bytes": int(size or 0)}
