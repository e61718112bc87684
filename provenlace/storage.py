"""Where intermediate results are written: the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; only where that is unset on one machine, as in tests, a temporary folder."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not (named or sc.master.startswith("local[") or sc.master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="provenlace-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder, to go on from there: what reads it often derives it once, and a lost executor loses nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
