"""Running lengths along paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Steps of a path that one window partition holds at most.
STRIDE = 65_536


def with_lengths(steps: DataFrame, segments: DataFrame) -> DataFrame:
    return steps.join(segments.select("node", "length"), "node")


def prefix(steps: DataFrame, stride: int = STRIDE) -> DataFrame:
    """Adds s0 and s1, the bases of a path before a step and up to its end, to steps with lengths.

    Sums are taken in strides of a path and the strides' totals added up, so a chromosome-long path is spread over tasks.
    """
    d = steps.withColumn("_k", F.expr(f"step_rank div {stride}L"))
    per = Window.partitionBy("path_id").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    base = d.groupBy("path_id", "_k").agg(F.sum("length").alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(per), F.lit(0))).drop("_sum")
    s1 = F.sum("length").over(Window.partitionBy("path_id", "_k").orderBy("step_rank").rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_in", s1).join(base, ["path_id", "_k"])
    return d.withColumn("s1", (F.col("_base") + F.col("_in")).cast("long")).withColumn("s0", (F.col("s1") - F.col("length")).cast("long")).drop("_k", "_in", "_base")


def located(steps: DataFrame, segments: DataFrame, stride: int = STRIDE) -> DataFrame:
    """Steps with length, s0 and s1."""
    return prefix(with_lengths(steps, segments), stride)


def checkpoints(located_steps: DataFrame, every: int = 4096) -> DataFrame:
    """(path_id, checkpoint_index, cumulative): bases before steps 0, every, 2 every ... and, where a path's step count is a multiple, its whole length."""
    if every <= 0:
        raise ValueError("checkpoints need a positive number of steps")
    inner = located_steps.where(F.col("step_rank") % every == 0).select("path_id", F.expr(f"step_rank div {every}L").alias("checkpoint_index"), F.col("s0").alias("cumulative"))
    ends = located_steps.where((F.col("step_rank") + 1) % every == 0).select("path_id", F.expr(f"(step_rank + 1) div {every}L").alias("checkpoint_index"), F.col("s1").alias("cumulative"))
    return inner.unionByName(ends).groupBy("path_id", "checkpoint_index").agg(F.min("cumulative").alias("cumulative"))


def length_before(located_steps: DataFrame, marks: DataFrame, points: DataFrame, every: int = 4096) -> DataFrame:
    """(path_id, step, cumulative) for points(path_id, step): the nearest checkpoint plus the steps after it."""
    p = points.withColumn("_c", F.expr(f"step div {every}L"))
    p = p.join(marks.withColumnRenamed("checkpoint_index", "_c"), ["path_id", "_c"])
    tail = located_steps.select("path_id", "step_rank", "length", F.expr(f"step_rank div {every}L").alias("_c"))
    got = p.join(tail, ["path_id", "_c"], "left").groupBy("path_id", "step").agg(F.max("cumulative").alias("_at"), F.coalesce(F.sum(F.when(F.col("step_rank") < F.col("step"), F.col("length"))), F.lit(0)).alias("_more"))
    return got.select("path_id", "step", (F.col("_at") + F.col("_more")).alias("cumulative"))


def total_lengths(steps_with_lengths: DataFrame) -> DataFrame:
    """(path_id, step_count, total_length)."""
    return steps_with_lengths.groupBy("path_id").agg(F.count("*").alias("step_count"), F.sum("length").alias("total_length"))
