"""Spark session helpers: local session for tests/bench and the checkpoint folder.

On a cluster the checkpoint folder comes from ``spark.checkpoint.dir`` (a shared
file system path set by whoever runs the cluster).  Only a local-mode session
with no such setting gets a private folder, so tests can run on one machine.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_LOCAL_CKPT: dict[str, str] = {}
_SHIPPED: set[str] = set()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "sigtrace") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SIGTRACE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.files.maxPartitionBytes", "1m")  # small local files still use every core
        .config("spark.sql.files.openCostInBytes", "64k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Settings every operator relies on (idempotent, cheap)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Later layers overwrite earlier ones when flattening fields.
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    # A batch of 10,000 (the default) long texts or packets takes hundreds of MB of a task, in Python and off the heap.
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make ``sigtrace`` importable in Python workers (``mapInPandas`` functions live in it).

    The package is zipped once per application and added with ``addPyFile``, which
    distributes it to every executor - the same thing ``--py-files`` does at submit time.
    """
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    # A driver-side build artefact, not data: addPyFile serves it to the executors.
    out = os.path.join(tempfile.mkdtemp(prefix="sigtrace-pyfiles-"), "sigtrace.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(pkg_dir):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, read from the session.

    ``spark.checkpoint.dir`` (or a folder already set on the context) wins.  Only
    a local-mode session without either gets a private folder under the system
    temp dir; a cluster session without a shared folder is an error, because a
    machine-local folder would not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            configured = None
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) for this cluster")
    key = sc.applicationId
    if key not in _LOCAL_CKPT:
        _LOCAL_CKPT[key] = tempfile.mkdtemp(prefix="sigtrace-ckpt-")
    sc.setCheckpointDir(_LOCAL_CKPT[key])
    return sc.getCheckpointDir() or _LOCAL_CKPT[key]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for written intermediate tables."""
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{uuid.uuid4().hex[:12]}"
