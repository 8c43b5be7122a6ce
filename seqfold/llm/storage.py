"""Lineage cuts and tables in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder. Where spark.checkpoint.dir is unset, one process alone (local mode, as in tests) gets a temporary folder;
    a cluster has to name a folder that all its machines share."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def unused(df: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores before it until no column of df is named so, whatever the case."""
    taken = {c.lower() for c in df.columns}
    return [next(n for i in range(len(taken) + 1) if (n := "_" * i + name).lower() not in taken) for name in names]


def kept(df: DataFrame) -> DataFrame:
    """df, written once to the checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
