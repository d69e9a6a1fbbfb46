"""Neighbourhoods, induced subgraphs and oriented adjacency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Nodes of a frontier that are sent to every task instead of dealing out the links by node.
FEW = 65_536


def bfs(links: DataFrame, seeds: DataFrame, max_nodes: int | None = None, max_depth: int | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(node, level, position): nodes in the order found from the sorted distinct seeds.

    Levels are complete ones; within a level nodes come by the position of their first parent, then the ordinal of the link,
    then the name. The search stops at max_nodes nodes; more seeds than that, and seeds that are not among `nodes`, are errors.
    The links' ends are written once. Each level sends its frontier to them, or meets them by a shuffle if it has over FEW nodes, and cuts the lineage. Only a limit needs the order within a level: of a capped search at
    most max_nodes rows a level are ranked, the first ones being picked by all tasks; without a limit position is null.
    """
    start = seeds.select("node").distinct()
    if nodes is not None:
        unknown = start.join(nodes.select("node"), "node", "left_anti").limit(1).collect()
        if unknown:
            raise ValueError(f"unknown node {unknown[0].node!r}")
    capped = max_nodes is not None
    first = (F.row_number().over(Window.orderBy("node")) - 1).cast("long") if capped else F.lit(None).cast("long")
    found = start.withColumn("level", F.lit(0))
    found = cut((found.orderBy("node").limit(max_nodes + 1) if capped else found).withColumn("position", first))
    count = frontier_size = found.count()
    if max_nodes is not None and count > max_nodes:
        raise ValueError(f"the start nodes exceed the limit of {max_nodes}")
    ends = cut(links.select("src", "dst", "ordinal") if capped else links.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    frontier, level = found, 0
    while frontier_size and (max_nodes is None or count < max_nodes) and (max_depth is None or level < max_depth):
        level += 1
        edge = frontier.select(F.col("node").alias("_from"), "position")
        edge = F.broadcast(edge) if frontier_size <= FEW else edge
        by = ["position", "ordinal"] if capped else []
        met = ends.join(edge, F.col("src") == F.col("_from")).select(F.col("dst").alias("nbr"), *by)
        met = met.unionByName(ends.join(edge, F.col("dst") == F.col("_from")).select(F.col("src").alias("nbr"), *by))
        step = met.groupBy(F.col("nbr").alias("_node")).agg(F.min(F.struct("position", "ordinal")).alias("_by")) if capped else met.select(F.col("nbr").alias("_node")).distinct()
        new = step.withColumnRenamed("_node", "node").join(found.select("node"), "node", "left_anti")
        if capped:
            new = new.orderBy("_by", "node").limit(max_nodes - count)
            new = new.withColumn("level", F.lit(level)).withColumn("position", (F.row_number().over(Window.orderBy("_by", "node")) - 1 + count).cast("long")).drop("_by")
        else:
            new = new.withColumn("level", F.lit(level)).withColumn("position", F.lit(None).cast("long"))
        frontier = cut(new)
        frontier_size = frontier.count()
        found = found.unionByName(frontier)  # of tables that are cut already; every few levels they are made one
        if level % 8 == 0:
            found = cut(found)
        count += frontier_size
    return found


def induced_segments(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    return segments.join(nodes.select("node").distinct(), "node", "left_semi")


def induced_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links with both ends among the nodes."""
    n = nodes.select("node").distinct()
    return links.join(n, F.col("src") == F.col("node"), "left_semi").join(n, F.col("dst") == F.col("node"), "left_semi")


def orphan_links(links: DataFrame, segments: DataFrame) -> DataFrame:
    """Links with an end that has no segment."""
    s = segments.select("node")
    known = lambda c, end: c.join(s, F.col(end) == F.col("node"), "left_anti")
    return known(links, "src").unionByName(known(links.join(s, F.col("src") == F.col("node"), "left_semi"), "dst"))


def half_edges(links: DataFrame) -> DataFrame:
    """(node, side, nbr, nbr_side, overlap): for each link both views. A link leaves the end side of + and the start side of -, and enters the other one."""
    out = F.when(F.col("src_orient") == "+", "end").otherwise("start")
    into = F.when(F.col("dst_orient") == "+", "start").otherwise("end")
    a = links.select(F.col("src").alias("node"), out.alias("side"), F.col("dst").alias("nbr"), into.alias("nbr_side"), "overlap")
    b = links.select(F.col("dst").alias("node"), into.alias("side"), F.col("src").alias("nbr"), out.alias("nbr_side"), "overlap")
    return a.unionByName(b)


def children(links: DataFrame, node: str, direction: int) -> DataFrame:
    """Neighbours across the start side (0) or the end side (1) of a node."""
    if direction not in (0, 1):
        raise ValueError("direction is 0 or 1")
    side = "end" if direction else "start"
    return half_edges(links).where((F.col("node") == node) & (F.col("side") == side)).select("nbr", "nbr_side", "overlap").distinct()


def neighbours(links: DataFrame, node: str) -> DataFrame:
    """(side, nbr) of a node, start side first, with repeats."""
    return half_edges(links).where(F.col("node") == node).select("side", "nbr").orderBy(F.col("side") == "end", "nbr")


def missing_edges(steps: DataFrame, links: DataFrame) -> DataFrame:
    """Consecutive steps of a path that no link joins: (path_id, step_rank)."""
    w = Window.partitionBy("path_id").orderBy("step_rank")
    s = steps.withColumn("nbr", F.lead("node").over(w)).withColumn("_r", F.lead("is_reverse").over(w)).where("nbr is not null")
    s = s.select("path_id", "step_rank", "node", F.when(F.col("is_reverse"), "start").otherwise("end").alias("side"), "nbr", F.when(F.col("_r"), "end").otherwise("start").alias("nbr_side"))
    return s.join(half_edges(links).select("node", "side", "nbr", "nbr_side").distinct(), ["node", "side", "nbr", "nbr_side"], "left_anti").select("path_id", "step_rank")


def path_sequences(steps: DataFrame, segments: DataFrame, revcomp) -> DataFrame:
    """(path_id, sequence): the steps' sequences one after another, reverse-complemented on reversed ones."""
    s = steps.join(segments.select("node", "seq"), "node")
    piece: Column = F.when(F.col("is_reverse"), revcomp(F.col("seq"))).otherwise(F.col("seq"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col("step_rank"), piece.alias("s")))), lambda x: x["s"])
    return s.groupBy("path_id").agg(F.array_join(parts, "").alias("sequence"))


def remove_nodes(links: DataFrame, segments: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, links) without the nodes and every link that touches them."""
    n = nodes.select("node").distinct()
    left = links.join(n, F.col("src") == F.col("node"), "left_anti").join(n, F.col("dst") == F.col("node"), "left_anti")
    return segments.join(n, "node", "left_anti"), left
