"""An extension of ours: path records that arrive as a stream of text files are appended to the step tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.gfa import parse_steps


def step_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Steps of the P and W lines of text files that appear in a folder; path_id is a hash of the record, so that a replay gives the same rows."""
    lines = spark.readStream.text(folder).where("value like 'P\t%' or value like 'W\t%'")
    f = F.split("value", "\t")
    kind = F.substring("value", 1, 1)
    lines = lines.select(F.xxhash64("value").alias("path_id"), kind.alias("record_type"), F.when(kind == "P", f[2]).otherwise(f[6]).alias("steps_text"))
    return parse_steps(lines)


def append_steps(spark: SparkSession, folder: str, out: str, checkpoint: str):
    """Process what is there and stop; exactly once across restarts, by the checkpoint folder."""
    return step_stream(spark, folder).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
