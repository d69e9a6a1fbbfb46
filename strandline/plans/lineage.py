"""Cutting lineage through the session's shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Eagerly checkpoint into the folder of spark.checkpoint.dir. Where none is set, a local session (tests) gets a folder of its own;
    on a cluster that is an error, as a folder of one machine would lose its contents with it."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="strandline-"))
    return df.checkpoint(eager=True)
