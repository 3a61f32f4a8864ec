"""Cutting long plans off: a table in the folder that all machines share stands for the steps before it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder of ``spark.checkpoint.dir``, so that lost executors do not undo it. A
    temporary folder is used only on a single machine (``local[...]``)."""
    context = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="engine-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return df.checkpoint()
