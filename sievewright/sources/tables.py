"""Tables of a data folder, and folders shared by all executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of the folder; the parquet reader prunes columns and takes pushed filters."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder of ``spark.checkpoint.dir``; where that is unset, to a temporary one if all tasks run in
    this machine's single JVM, as in local tests, and nowhere else: a cluster's executors couldn't share it."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isEmpty():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sievewright-")
        atexit.register(shutil.rmtree, folder, True)
    context.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the checkpoint folder; its lineage ends there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
