"""Session helpers: a tuned local session for tests and scratch folders.

On a cluster the session comes from the caller; nothing here overrides
settings that are already present.  ``scratch_dir`` always lives under the
shared ``spark.checkpoint.dir``; only when that is unset (tests, local runs)
a fresh temporary folder is created and registered as the checkpoint dir.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings that matter for the plans in this package.  AQE re-plans joins and
# coalesces partitions at run time; skew join splits hot join keys.
TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "ticketflow") -> SparkSession:
    """Local session for tests and benchmarks (UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
    )
    for k, v in TUNING.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint dir; a temporary one only for a local master.

    On any other master executors could not read the driver's own folder, so
    an unset ``spark.checkpoint.dir`` is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
    else:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    return sc.getCheckpointDir()


def ship_package(spark: SparkSession) -> None:
    """Send this package's Python files to the executors (once per context).

    Tasks that run Python import from it; a cluster that only has the driver's
    copy needs no installation on its workers.
    """
    sc = spark.sparkContext
    if getattr(sc, "_ticketflow_shipped", False):
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="run-")) / "ticketflow_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    sc.addPyFile(str(archive))      # served by the driver, not read from its folder
    sc._ticketflow_shipped = True


def materialize(df):
    """Eager reliable checkpoint (shared checkpoint dir) of a small derived
    table that several branches read: the large input is scanned once and
    the lineage is cut, so a lost executor does not re-run the scan."""
    from pyspark import StorageLevel

    ensure_checkpoint_dir(df.sparkSession)
    # persisted first: the checkpoint write then reads the cached blocks
    # instead of recomputing (rescanning) the input a second time
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint dir."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "ticketflow", f"{name}-{uuid.uuid4().hex[:12]}")
