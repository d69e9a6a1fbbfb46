"""The index on disk: Parquet tables laid out for the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators.communities import SHARED, classify_links
from .gfa import Graph

TABLES = ("segments", "links", "paths", "steps", "headers", "communities")


def save(graph: Graph, path: str, located_steps: DataFrame | None = None, tracks: tuple[DataFrame, DataFrame] | None = None, checkpoints: DataFrame | None = None) -> None:
    """Write a graph with communities. Segments and links are partitioned by community, so that fetching one reads its files only;
    steps are clustered by path (with their prefix sums, if given) and once more by node, so that range reads and node lookups
    both prune row groups. Nothing is overwritten; a table appears when it is complete."""
    if graph.communities is None:
        raise ValueError("assign communities first")
    c = graph.communities
    one = {"mode": "error"}
    graph.segments.join(c, "node").repartition("community_id").sortWithinPartitions("community_id", "ordinal").write.partitionBy("community_id").parquet(f"{path}/segments", **one)
    classify_links(graph.links, c).repartition("community_id").sortWithinPartitions("community_id", "ordinal").write.partitionBy("community_id").parquet(f"{path}/links", **one)
    c.sortWithinPartitions("node").write.parquet(f"{path}/communities", **one)
    graph.paths.write.parquet(f"{path}/paths", **one)
    steps = graph.steps if located_steps is None else located_steps
    steps.repartitionByRange("path_id", "step_rank").sortWithinPartitions("path_id", "step_rank").write.parquet(f"{path}/steps", **one)
    steps.repartitionByRange("node", "path_id", "step_rank").sortWithinPartitions("node", "path_id", "step_rank").write.parquet(f"{path}/steps_by_node", **one)
    if graph.headers is not None:
        graph.headers.coalesce(1).write.parquet(f"{path}/headers", **one)
    if checkpoints is not None:
        checkpoints.write.parquet(f"{path}/checkpoints", **one)
    if tracks is not None:
        tracks[0].write.parquet(f"{path}/tracks", **one)
        tracks[1].repartitionByRange("track_id", "start").sortWithinPartitions("track_id", "start").write.parquet(f"{path}/entries", **one)


def _checked(df: DataFrame, want) -> DataFrame:
    missing = [f.name for f in want if f.name not in df.columns]
    if missing:
        raise ValueError(f"not a table of this index: columns {missing} are missing")
    return df


def load(spark: SparkSession, path: str) -> Graph:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return Graph(
        _checked(read("segments"), schema.SEGMENT), _checked(read("links"), schema.LINK), _checked(read("paths"), schema.PATH), _checked(read("steps"), schema.STEP),
        read("headers"), _checked(read("communities"), schema.NODE_COMMUNITY),
    )


def load_tracks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    tracks, entries = (spark.read.parquet(f"{path}/{n}") for n in ("tracks", "entries"))
    return _checked(tracks, schema.TRACK), _checked(entries, schema.ENTRY)


def community_of(graph: Graph, node: str) -> int | None:
    row = graph.communities.where(F.col("node") == node).limit(1).collect()
    return row[0].community_id if row else None


def fetch_community(graph: Graph, community_id: int | None = None, node: str | None = None) -> DataFrame:
    """(kind, ordinal, line) of one community's segments and links; by node, if one is given. SHARED holds the links between communities."""
    if node is not None:
        community_id = community_of(graph, node)
        if community_id is None:
            raise ValueError(f"unknown node {node!r}")
    if community_id is None:
        raise ValueError("give a community or a node")
    pick = lambda df, kind: df.where(F.col("community_id") == community_id).select(F.lit(kind).alias("kind"), "ordinal", F.col("raw").alias("line"))
    links = graph.links if "community_id" in graph.links.columns else classify_links(graph.links, graph.communities)
    segments = graph.segments if "community_id" in graph.segments.columns else graph.segments.join(graph.communities, "node")
    return pick(segments, "S").unionByName(pick(links, "L"))


__all__ = ["SHARED", "TABLES", "community_of", "fetch_community", "load", "load_tracks", "save"]
