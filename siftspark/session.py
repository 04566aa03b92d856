"""Session settings, checkpoints and the shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("siftspark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    ship(spark)
    return spark


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by writing it to the cluster's shared folder.

    The folder is the one in ``spark.checkpoint.dir``. Only where that is unset
    (local tests) a temporary folder of this process is used; a cluster without
    the setting is refused, since its executors could not share that folder.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="siftspark-")
            atexit.register(shutil.rmtree, folder, True)
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Let the Python workers import this package from where the driver has it.

    The folder is put on the workers' path. Where executors do not share that folder,
    install the package there or add it with ``spark.submit.pyFiles``.
    """
    root = str(Path(__file__).resolve().parent.parent)
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, path]) if path else root
