"""Session helpers: a configured local session for tests and a shared folder for state."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
LOCAL_RE = r"local(\[[^\]]*\])?"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "eventpipe") -> SparkSession:
    """Session used by tests and the bench; on a cluster the caller builds its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    if re.fullmatch(LOCAL_RE, master):  # elsewhere the executors must share the warehouse: the cluster names it
        builder = builder.config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="eventpipe-warehouse-"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names; set one only where it is unset.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is used as is.
    Only a local session without it (tests) gets a fresh scratch folder; on any other
    master a folder of this machine would be lost to the executors, so that raises.
    """
    current = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if current:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        return current
    master = spark.sparkContext.master
    if not re.fullmatch(LOCAL_RE, master):
        raise RuntimeError(f"{CHECKPOINT_KEY} is not set; on {master} it must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="eventpipe-ckpt-")
    spark.conf.set(CHECKPOINT_KEY, path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def state_path(spark: SparkSession, *parts: str) -> str:
    """A fresh folder below the shared checkpoint folder, for stream checkpoints and tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "eventpipe", *parts, uuid.uuid4().hex)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``eventpipe`` importable in the Python workers (UDFs, ``mapInPandas``).

    The package is zipped once per application and added with ``addPyFile``, so
    Spark ships it to every executor; nothing has to be installed there.
    """
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    zpath = os.path.join(tempfile.mkdtemp(prefix="eventpipe-pyfiles-"), "eventpipe.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(sc.applicationId)
