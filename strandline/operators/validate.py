"""Integrity rules as checks over whole tables; a violation is a ValueError that shows a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.gfa import Graph
from .traverse import orphan_links


def _first(df: DataFrame, message: str) -> None:
    row = df.limit(1).collect()
    if row:
        raise ValueError(f"{message}: {row[0].asDict()}")


def duplicate_segments(segments: DataFrame) -> DataFrame:
    return segments.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")


def unknown_steps(steps: DataFrame, segments: DataFrame) -> DataFrame:
    return steps.join(segments.select("node"), "node", "left_anti")


def length_conflicts(segments: DataFrame) -> DataFrame:
    """Segments whose LN tag disagrees with their sequence: an error for coordinates only."""
    return segments.where("seq <> '*' and element_at(tags, 'LN') is not null and substring(element_at(tags, 'LN'), 3) <> cast(length(seq) as string)").select("node", "length")


def check(graph: Graph, coordinates: bool = False) -> None:
    """Raise on a repeated segment, a link or a step without its segment and, for coordinates, on lengths that disagree."""
    _first(duplicate_segments(graph.segments), "duplicate segment")
    _first(orphan_links(graph.links, graph.segments).select("src", "dst"), "a link's end has no segment")
    _first(unknown_steps(graph.steps, graph.segments).select("path_id", "step_rank", "node"), "a step on an unknown segment")
    if coordinates:
        _first(length_conflicts(graph.segments), "sequence and LN tag disagree")
