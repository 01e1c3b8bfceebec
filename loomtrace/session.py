"""Session defaults and the shared folder that cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def local_session(cores: str = "8", name: str = "loomtrace") -> SparkSession:
    """A session for tests and benchmarks on one machine. A cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LOOMTRACE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once a session, unless it is installed or on ``PYTHONPATH``."""
    root = str(PACKAGE.parent)
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if PACKAGE.parent.name in ("site-packages", "dist-packages") or root in paths or not PACKAGE.is_dir():
        return
    sc = spark.sparkContext
    if getattr(sc, "_loomtrace_shipped", False):
        return
    # Spark serves the driver's file to all executors
    path = os.path.join(sc._temp_dir, f"{PACKAGE.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(path)
    sc._loomtrace_shipped = True


def _tidy(spark: SparkSession) -> None:
    """Have the session's own folder below the checkpoint folder deleted when the driver ends."""
    sc = spark.sparkContext
    own = sc._jvm.org.apache.hadoop.fs.Path(sc._jsc.sc().getCheckpointDir().get())
    own.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(own)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``.

    Only a ``local`` master without such a setting (tests, one machine) gets a temporary
    folder; on a cluster that would be unreadable for the other machines, so it is an
    error. What a session writes there lies in a folder of its own, which goes with it.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="loomtrace-checkpoint-"))
    if not getattr(sc, "_loomtrace_tidy", False):
        _tidy(spark)
        sc._loomtrace_tidy = True


def shared_folder(spark: SparkSession, name: str) -> str:
    """Address of a new folder beside the checkpoints, which all executors see."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared checkpoint folder, and its path for ``discard``."""
    spark = df.sparkSession
    path = shared_folder(spark, "table")
    df.write.parquet(path)
    return spark.read.parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of ``written``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
