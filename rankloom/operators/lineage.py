"""Cutting lineage in the cluster's shared folder, and dealing rows out."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, by a checkpoint in ``spark.checkpoint.dir``; only a local session may be without that."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="rankloom-checkpoint-"))
    return df.checkpoint()


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt over all cores by ``key``.

    A file's splits say nothing of where its rows are: one row group stands in one split, the others are empty.
    """
    tasks = max(2 * rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions())
    return rows.repartition(tasks, key)
