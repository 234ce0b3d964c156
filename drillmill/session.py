"""Session helpers: building one for tests and cutting lineage safely."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(cpus: int | str = "*", partitions: int = 8, app: str = "drillmill") -> SparkSession:
    """A local session with the settings that the tests and the bench use; its workers find this package."""
    root = str(Path(__file__).resolve().parents[1])
    os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (root, os.environ.get("PYTHONPATH")) if x)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("DRILLMILL_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset, one of our own, in local mode only."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", "")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named and not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or _own_folder())
    return sc._jsc.sc().getCheckpointDir().get()


def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="drillmill-checkpoint-")
    atexit.register(shutil.rmtree, folder, True)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and continues from the files, so a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df, computed and written once; marked for a broadcast if it has at most so many rows, else left for a shuffle."""
    once = cut(df)
    return F.broadcast(once) if once.limit(rows + 1).count() <= rows else once
