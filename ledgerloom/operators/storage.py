"""Cutting lineage between the rounds of an iterative operator."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def shared(df: DataFrame) -> str:
    """The checkpoint folder that the cluster shares (spark.checkpoint.dir).

    Only where none is set, as on a single machine, a local folder is.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(at or f"file://{tempfile.mkdtemp(prefix='ledgerloom-')}")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder."""
    shared(df)
    return df.checkpoint(eager=True)
