"""Cutting of lineage in loops, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def saved(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint: written once under ``spark.checkpoint.dir``, so no later job repeats or loses it.

    In local mode a temporary folder takes that setting's place if it is unset; on a cluster that is an error.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            path = "file://" + tempfile.mkdtemp(prefix="civicfeed-")
        context.setCheckpointDir(path)
    return df.checkpoint()
