"""Cutting lineage: rows written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the checkpoint folder now. The folder is spark.checkpoint.dir's, or the one that the context has;
    where neither is set and all runs on this machine, one of our own. On a cluster it must be set."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        path = sc.getConf().get("spark.checkpoint.dir")
        if not path and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="affinis-"))
    return df.checkpoint(eager=True)
