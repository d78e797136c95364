"""The folder that all executors share, and tables that cut a plan's lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own, any other one an error."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="scriptora-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = "file://" + own
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: what reads it doesn't run its plan again."""
    spark = df.sparkSession
    at = shared_folder(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return df.checkpoint()
