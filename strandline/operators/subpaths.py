"""Runs of steps, and their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import name_base, name_start


#: Steps of a path that one window partition holds at most, and steps of a path that one group of a range join holds.
STRIDE, JOINED = 65_536, 256


def postings(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """Steps on any of the nodes."""
    return steps.join(nodes.select("node").distinct(), "node", "left_semi")


def node_runs(steps: DataFrame, nodes: DataFrame, least: int = 2) -> DataFrame:
    """(path_id, start_step, step_count): maximal runs of consecutive steps on the nodes, of at least `least` steps."""
    return step_islands(postings(steps, nodes)).where(F.col("step_count") >= least)


def step_islands(steps: DataFrame, stride: int = STRIDE) -> DataFrame:
    """(path_id, start_step, step_count): maximal runs of consecutive step_rank, which must not repeat within a path.

    They are found in strides of a path; of a stride only the at most two that touch its ends can go on in another one, so only
    those, a few a stride, meet in one window by path.
    """
    w = Window.partitionBy("path_id", "_k").orderBy("step_rank")
    s = steps.select("path_id", "step_rank", F.expr(f"step_rank div {stride}L").alias("_k")).withColumn("_g", F.col("step_rank") - F.row_number().over(w))
    runs = s.groupBy("path_id", "_k", "_g").agg(F.min("step_rank").alias("start_step"), F.count("*").alias("step_count"))
    edge = (F.col("start_step") % stride == 0) | ((F.col("start_step") + F.col("step_count")) % stride == 0)
    p = Window.partitionBy("path_id").orderBy("start_step")
    split = runs.where(edge).withColumn("_new", F.when(F.col("start_step") == F.lag(F.col("start_step") + F.col("step_count")).over(p), 0).otherwise(1)).withColumn("_i", F.sum("_new").over(p))
    split = split.groupBy("path_id", "_i").agg(F.min("start_step").alias("start_step"), F.sum("step_count").alias("step_count"))
    key = ["path_id", "start_step", "step_count"]
    return runs.where(~edge).select(*key).unionByName(split.select(*key))


def posting_runs(steps: DataFrame, nodes: DataFrame, least: int = 2) -> DataFrame:
    """The steps of node_runs(steps, nodes, least), each with its run's start_step and step_count: the postings themselves, met by equality.

    Each step finds its run by the stretch of JOINED steps it is in, as in run_steps, but only postings go in.
    """
    s = postings(steps, nodes)
    return run_steps(s, step_islands(s).where(F.col("step_count") >= least))


def merge_runs(runs: DataFrame) -> DataFrame:
    """Overlapping and adjacent runs of a path made one."""
    w = Window.partitionBy("path_id").orderBy("start_step", "step_count")
    end = F.col("start_step") + F.col("step_count")
    r = runs.withColumn("_e", end).withColumn("_before", F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    r = r.withColumn("_i", F.sum(F.when(F.col("start_step") <= F.col("_before"), 0).otherwise(1)).over(w))
    return r.groupBy("path_id", "_i").agg(F.min("start_step").alias("start_step"), (F.max("_e") - F.min("start_step")).alias("step_count")).select("path_id", "start_step", "step_count")


def run_steps(steps: DataFrame, runs: DataFrame) -> DataFrame:
    """Steps of the runs, with start_step and step_count; a step in several runs once for each.

    Runs and steps meet by stretches of JOINED steps of a path, so that a step is held only against the runs of its stretch, and
    a long path is many groups.
    """
    last = F.expr(f"(start_step + step_count - 1) div {JOINED}L")
    r = runs.where("step_count > 0").select(F.col("path_id").alias("_p"), "start_step", "step_count", F.explode(F.sequence(F.expr(f"start_step div {JOINED}L"), last)).alias("_s"))
    on = (F.col("path_id") == F.col("_p")) & (F.expr(f"step_rank div {JOINED}L") == F.col("_s")) & (F.col("step_rank") >= F.col("start_step")) & (F.col("step_rank") < F.col("start_step") + F.col("step_count"))
    return steps.join(r, on).drop("_p", "_s")


def _joined(tokens: Column, separator: str) -> Column:
    """Step texts in the order of their ranks."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("step_rank"), tokens.alias("t")))), lambda x: x["t"]), separator)


def step_text(steps: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """by + (p_steps, w_steps): the two spellings of a run's steps; and more aggregates of them."""
    p = F.concat(F.col("node"), F.when(F.col("is_reverse"), "-").otherwise("+"))
    w = F.concat(F.when(F.col("is_reverse"), "<").otherwise(">"), F.col("node"))
    return steps.groupBy(*by).agg(_joined(p, ",").alias("p_steps"), _joined(w, "").alias("w_steps"), *more)


def slice_overlaps(overlaps: Column, start: Column, count: Column) -> Column:
    """The count - 1 overlaps between the steps of a run; * stays *; too few are an error."""
    parts = F.split(overlaps, ",")
    short = F.size(parts) < start + count - 1
    cut = F.array_join(F.slice(parts, (start + 1).cast("int"), F.greatest(count - 1, F.lit(1)).cast("int")), ",")
    error = F.raise_error(F.lit("a path has fewer overlaps than its steps need")).cast("string")
    return F.when(overlaps.isNull() | overlaps.isin("*", ""), "*").when(count < 2, "*").when(short, error).otherwise(cut)


def _tail(tags: Column) -> Column:
    return F.when(F.size(tags) > 0, F.concat(F.lit("\t"), F.array_join(tags, "\t"))).otherwise("")


def _star(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("*"))


def _plain(is_p: Column) -> Column:
    """The record of a run without coordinates, of the columns of step_text and paths."""
    mark = F.concat(F.lit("#subpath_"), F.col("start_step"), F.lit("_"), F.col("start_step") + F.col("step_count") - 1)
    p = F.concat(F.lit("P\t"), F.col("name"), mark, F.lit("\t"), F.col("p_steps"), F.lit("\t"), slice_overlaps(F.col("overlaps"), F.col("start_step"), F.col("step_count")))
    w = F.concat(F.concat_ws("\t", F.lit("W"), "sample", F.col("hap").cast("string"), F.concat("seq_id", mark)), F.lit("\t*\t*\t"), F.col("w_steps"))
    return F.concat(F.when(is_p, p).otherwise(w), _tail(F.col("tags")))


def subpath_lines(paths: DataFrame, steps: DataFrame, runs: DataFrame) -> DataFrame:
    """(path_id, start_step, line): a record for each run, named by its step numbers, without coordinates."""
    t = step_text(run_steps(steps, runs), ["path_id", "start_step", "step_count"]).join(paths, "path_id")
    return t.select("path_id", "start_step", _plain(F.col("record_type") == "P").alias("line"))


def located_subpath_lines(paths: DataFrame, located_steps: DataFrame, runs: DataFrame) -> DataFrame:
    """(path_id, start_step, line, has_coordinates): as subpath_lines, but with exact coordinates where the path has them.

    A path with overlaps, a walk without coordinates, and a run that ends beyond the declared end fall back to step numbers.
    """
    return located_lines(paths, run_steps(located_steps, runs))


def located_lines(paths: DataFrame, s: DataFrame) -> DataFrame:
    """As located_subpath_lines, of the located steps of runs, each with its run's start_step and step_count."""
    key = ["path_id", "start_step", "step_count"]
    t = step_text(s, key, F.min("s0").alias("_from"), F.max("s1").alias("_to")).join(paths, "path_id")
    is_p = F.col("record_type") == "P"
    base = F.when(is_p, F.coalesce(name_start(F.col("name")), F.lit(0))).otherwise(F.col("seq_start"))
    bare = F.coalesce(F.col("overlaps"), F.lit("*")).isin("*", "")
    end = F.col("_base") + F.col("_to")
    declared = F.when(is_p, F.regexp_extract("name", ":[0-9]+-([0-9]+)$", 1)).otherwise(F.col("seq_end").cast("string"))
    limit = F.when((declared != "") & declared.isNotNull(), declared.cast("long"))
    t = t.withColumn("_base", base)
    ok = F.coalesce(F.col("_base").isNotNull() & bare & (limit.isNull() | (end <= limit)) & (is_p | F.col("seq_end").isNotNull()), F.lit(False))
    name = F.concat(name_base(F.col("name")), F.lit(":"), F.col("_base") + F.col("_from"), F.lit("-"), end)
    p = F.concat(F.lit("P\t"), name, F.lit("\t"), F.col("p_steps"), F.lit("\t*"))
    w = F.concat_ws("\t", F.lit("W"), "sample", F.col("hap").cast("string"), "seq_id", (F.col("_base") + F.col("_from")).cast("string"), end.cast("string"), "w_steps")
    line = F.concat(F.when(is_p, p).otherwise(w), _tail(F.col("tags")))
    t = t.withColumn("has_coordinates", ok)
    return t.select("path_id", "start_step", F.when(F.col("has_coordinates"), line).otherwise(_plain(is_p)).alias("line"), "has_coordinates")


def full_lines(paths: DataFrame, steps: DataFrame) -> DataFrame:
    """(path_id, line): each path's whole record. Steps are gathered and put in order once, and spelled as the record needs; of a path that has
    several records each gets its line."""
    in_order = F.array_sort(F.collect_list(F.struct("step_rank", "node", "is_reverse"))).alias("_steps")
    t = steps.groupBy("path_id").agg(in_order).join(paths, "path_id")
    spelled = lambda f, separator: F.array_join(F.transform("_steps", f), separator)
    p_steps = spelled(lambda x: F.concat(x["node"], F.when(x["is_reverse"], "-").otherwise("+")), ",")
    w_steps = spelled(lambda x: F.concat(F.when(x["is_reverse"], "<").otherwise(">"), x["node"]), "")
    p = F.concat_ws("\t", F.lit("P"), "name", p_steps, F.coalesce(F.col("overlaps"), F.lit("*")))
    w = F.concat_ws("\t", F.lit("W"), "sample", F.col("hap").cast("string"), "seq_id", _star(F.col("seq_start")), _star(F.col("seq_end")), w_steps)
    return t.select("path_id", F.concat(F.when(F.col("record_type") == "P", p).otherwise(w), _tail(F.col("tags"))).alias("line"))
