"""Spark session defaults and lineage cuts.

On a cluster the session comes from the platform; ``get_spark`` only fills in
settings that are unset, so a cluster's own configuration always wins.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: ANSI semantics are assumed by the operators
# (``try_divide`` / ``try_cast`` where a division or cast may fail), AQE
# coalesces the many small shuffle outputs of per-key series work and splits
# skewed join partitions at run time.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Per-key series work is small in bytes but heavy in CPU (windows, array
    # folds, Python model fits); a low floor keeps AQE from merging such a
    # shuffle into a single task.  Large shuffles are still sized by bytes.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "tidal") -> SparkSession:
    """Return the active session, creating a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("TIDAL_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per session.

    Python tasks refer to its modules by name, so workers must be able to
    import them wherever they run and whatever their working folder is.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tidal_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tidal-ship-")) / "tidal_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(f.relative_to(root.parent)))
    sc.addPyFile(str(target))  # served to the executors by the driver
    sc._tidal_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Where none is named, a session whose tasks all run inside the driver's own
    process (``local[...]``) gets a scratch folder; on a cluster a folder of one
    machine would lose data, so the missing setting is an error.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_tidal_dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = sc._tidal_dir = tempfile.mkdtemp(prefix="tidal-ckpt-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder; survives executor loss."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet under the shared checkpoint folder and read it back.

    Used for small per-key tables that feed two branches of a plan (for
    example the per-key components and their global extremes): the upstream
    plan, which may scan the raw tables, then runs once, and the written
    table survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)

