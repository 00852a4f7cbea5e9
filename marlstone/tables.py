"""Reading input tables, and the folder in which plans cut their lineage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

from marlstone.errors import InvalidInput


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the cluster's shared folder; makes a folder of its own only on one machine (tests) whose session names none."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise InvalidInput("spark.checkpoint.dir must name a folder that all machines share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="marlstone-checkpoint-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder of this name beside the checkpoints, where all executors can read and write."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}"


def cut(frame: DataFrame, eager: bool = True) -> DataFrame:
    """Writes the frame to the shared checkpoint folder, so that what follows neither recomputes it nor depends on one executor."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=eager)
