"""Session helpers.

Library code never builds a session of its own; these helpers are for
tests, the bench and command-line use.  Cluster settings (shuffle
partitions, checkpoint directory, memory) come from the cluster config
and are only filled in here when they are unset.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every session of ours wants, cluster or local.
_SQL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # delete reliable checkpoint files once their RDDs are unreachable
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tidepanel", event_log_dir: str | None = None) -> SparkSession:
    """A local session for tests and the bench (never used on a cluster).
    ``event_log_dir`` turns on Spark's event log there (stage and task
    times without the web UI)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("TIDEPANEL_DRIVER_MEM", "16g"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="tp-wh-", dir="/tmp"))
    )
    for k, v in _SQL_DEFAULTS.items():
        builder = builder.config(k, v)
    if event_log_dir:
        builder = (builder.config("spark.eventLog.enabled", "true")
                   .config("spark.eventLog.dir", event_log_dir))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of intermediate data: ``spark.checkpoint.dir``.  On a
    cluster its absence is an error (a machine-local folder would differ from
    machine to machine); a local master gets a scratch folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    path = tempfile.mkdtemp(prefix="tp-ckpt-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tidepanel`` importable in the executors' Python workers (for
    ``applyInPandas``/``mapInPandas``): zip the package once per Spark
    application and add it with ``addPyFile`` - the runtime form of
    ``--py-files``.  A package installed on the cluster needs none of this,
    and then the import check below returns early."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    # installed on the cluster (pip or --py-files): nothing to ship
    if spark.conf.get("spark.tidepanel.shipPackage", "true").lower() == "false":
        return
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    fd, path = tempfile.mkstemp(prefix="tidepanel-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        for base, _, files in os.walk(pkg_dir):
            if "__pycache__" in base:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(app)


# A batch that goes to a Python worker: the rows it may have by default hold tens
# of MB of texts, which the JVM and the worker each keep beside their heaps.
ARROW_BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def prepare(spark: SparkSession) -> None:
    """Everything a query needs from the session it is given: the shared
    folder, the package in the workers and, where the session has no setting of
    its own, batches of bounded bytes between the JVM and Python.  Sessions
    without a classic SparkContext (Spark Connect) manage both on the
    server side; nothing is set there."""
    try:
        spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext
        return
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    key, size = ARROW_BATCH_BYTES
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, size)
