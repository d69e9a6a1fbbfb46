"""All paths that share nodes with a region of a reference path."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .subpaths import STRIDE, merge_runs, node_runs, run_steps, step_islands


def reference_runs(slices: DataFrame) -> DataFrame:
    """Exact runs of the reference paths, from their slices(path_id, step_rank); adjacent ones are one run."""
    return step_islands(slices.select("path_id", "step_rank").distinct())


def anchor_bounds(anchors: DataFrame) -> DataFrame:
    """(path_id, first, last, n_anchors) of anchor steps: map-side combined."""
    return anchors.groupBy("path_id").agg(F.min("step_rank").alias("first"), F.max("step_rank").alias("last"), F.count("*").alias("n_anchors"))


def haplotype_runs(located_steps: DataFrame, slices: DataFrame, gap: int | None = None) -> DataFrame:
    """(path_id, start_step, step_count): of each path in slices exactly its slice; of every other path that visits one of the
    slices' nodes the steps from its first visit to its last or, with a gap, each cluster of visits with at most `gap` bases
    between neighbours. Clusters of one visit count."""
    exact = reference_runs(slices)
    nodes = run_nodes(located_steps, exact)
    anchors = located_steps.join(nodes, "node", "left_semi").join(exact.select("path_id").distinct(), "path_id", "left_anti")
    if gap is None:
        other = anchor_bounds(anchors).select("path_id", F.col("first").alias("start_step"), (F.col("last") - F.col("first") + 1).alias("step_count"))
    else:
        other = cluster_runs(anchors, gap)
    return exact.unionByName(other)


def cluster_runs(anchors: DataFrame, gap: int, stride: int = STRIDE) -> DataFrame:
    """Runs of each path's anchors with at most `gap` bases between neighbours: session windows over coordinates.

    Clusters are formed in strides of a path; only the first and the last one of a stride can belong with one of another, so only
    those meet in one window by path.
    """
    w = Window.partitionBy("path_id", "_k").orderBy("step_rank")
    a = anchors.select("path_id", "step_rank", "s0", "s1", F.expr(f"step_rank div {stride}L").alias("_k"))
    a = a.withColumn("_new", F.when(F.col("s0") - F.lag("s1").over(w) > gap, 1).otherwise(0)).withColumn("_c", F.sum("_new").over(w))
    c = a.groupBy("path_id", "_k", "_c").agg(F.min("step_rank").alias("start_step"), F.max("step_rank").alias("_z"), F.min("s0").alias("s0"), F.max("s1").alias("s1"))
    c = c.withColumn("_last", F.max("_c").over(Window.partitionBy("path_id", "_k")))
    edge = (F.col("_c") == 0) | (F.col("_c") == F.col("_last"))
    p = Window.partitionBy("path_id").orderBy("start_step")
    split = c.where(edge).withColumn("_new", F.when(F.col("s0") - F.lag("s1").over(p) > gap, 1).otherwise(0)).withColumn("_i", F.sum("_new").over(p))
    split = split.groupBy("path_id", "_i").agg(F.min("start_step").alias("start_step"), F.max("_z").alias("_z"))
    both = c.where(~edge).select("path_id", "start_step", "_z").unionByName(split.select("path_id", "start_step", "_z"))
    return both.select("path_id", "start_step", (F.col("_z") - F.col("start_step") + 1).alias("step_count"))


def run_nodes(steps: DataFrame, runs: DataFrame) -> DataFrame:
    """Distinct nodes of all runs."""
    return run_steps(steps, runs).select("node").distinct()


__all__ = ["anchor_bounds", "cluster_runs", "haplotype_runs", "merge_runs", "node_runs", "reference_runs", "run_nodes"]
