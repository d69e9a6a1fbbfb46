"""Graph text out: ordered lines, listings, files."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.gfa import Graph
from .communities import SHARED, classify_links
from .subpaths import full_lines, located_lines, located_subpath_lines, node_runs, posting_runs, subpath_lines
from .traverse import induced_links, induced_segments

SECTIONS = {"H": 0, "G": 1, "P": 2}


def graph_lines(graph: Graph, headers: int | None = 1) -> DataFrame:
    """(section, part, ordinal, line) of header (the first `headers` lines; None: all), segments and links by community (the shared part last) and nothing else."""
    parts = []
    if graph.headers is not None and headers != 0:
        h = graph.headers.orderBy("ordinal") if headers is None else graph.headers.orderBy("ordinal").limit(headers)
        parts.append(h.select(F.lit(0).alias("section"), F.lit(0).cast("long").alias("part"), "ordinal", F.col("raw").alias("line")))
    s, links = graph.segments, graph.links
    if graph.communities is not None:
        if "community_id" not in s.columns:
            s = s.join(graph.communities, "node")
        if "community_id" not in links.columns:
            links = classify_links(links, graph.communities)
        links = links.withColumn("community_id", F.when(F.col("community_id") == SHARED, F.lit(2**62)).otherwise(F.col("community_id")))
    else:
        s, links = (d.withColumn("community_id", F.lit(0).cast("long")) for d in (s, links))
    for d in (s, links):
        parts.append(d.select(F.lit(1).alias("section"), F.col("community_id").alias("part"), "ordinal", F.col("raw").alias("line")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def subgraph_lines(graph: Graph, nodes: DataFrame, runs: DataFrame | None = None, located_steps: DataFrame | None = None, paths: bool = True) -> DataFrame:
    """Lines of the subgraph induced by the nodes, with its path runs (those given, else all runs of two or more steps on the
    nodes); with located_steps they carry coordinates where they can."""
    part = Graph(induced_segments(graph.segments, nodes), induced_links(graph.links, nodes), graph.paths, graph.steps, graph.headers, graph.communities)
    out = graph_lines(part)
    if not paths:
        return out
    if located_steps is None:
        lines = subpath_lines(graph.paths, graph.steps, node_runs(graph.steps, nodes) if runs is None else runs)
    else:
        lines = located_lines(graph.paths, posting_runs(located_steps, nodes)) if runs is None else located_subpath_lines(graph.paths, located_steps, runs)
        lines = lines.drop("has_coordinates")
    return out.unionByName(lines.select(F.lit(2).alias("section"), F.col("path_id").alias("part"), F.col("start_step").alias("ordinal"), "line"))


def whole_graph_lines(graph: Graph) -> DataFrame:
    """All lines, paths included; each link once."""
    p = full_lines(graph.paths, graph.steps).select(F.lit(2).alias("section"), F.col("path_id").alias("part"), F.lit(0).cast("long").alias("ordinal"), "line")
    return graph_lines(graph, None).unionByName(p)


def write_file(lines: DataFrame, path: str) -> int:
    """Write ordered lines to one local file, published by a rename; rows stream through the driver a partition at a time. Returns their number."""
    folder = os.path.dirname(os.path.abspath(path))
    n = 0
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as out:
        for row in lines.orderBy("section", "part", "ordinal").select("line").toLocalIterator(prefetchPartitions=True):
            out.write(row.line + "\n")
            n += 1
    os.replace(out.name, path)
    return n


def write_folder(lines: DataFrame, path: str) -> None:
    """Write ordered lines as part files, in parallel; in order of their names they are the text."""
    lines.orderBy("section", "part", "ordinal").select("line").write.mode("error").text(path)


def list_paths(paths: DataFrame) -> DataFrame:
    """(path_id, line): P and the name, or W and its five fields; an unknown coordinate is *."""
    star = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("*"))
    w = F.concat_ws("\t", F.lit("W"), "sample", F.col("hap").cast("string"), "seq_id", star("seq_start"), star("seq_end"))
    return paths.select("path_id", F.when(F.col("record_type") == "P", F.concat_ws("\t", F.lit("P"), "name")).otherwise(w).alias("line"))


def find_path(paths: DataFrame, name: str) -> DataFrame:
    """The first path of a name; none is an error."""
    found = paths.where(F.col("name") == name).orderBy("path_id").limit(1)
    if found.isEmpty():
        raise ValueError(f"unknown path {name!r}")
    return found


def find_walk(paths: DataFrame, sample: str, hap: int, seq_id: str, seq_start: int | None = None, seq_end: int | None = None) -> DataFrame:
    """The one walk of these fields; none, or several, is an error."""
    found = paths.where("record_type = 'W'").where((F.col("sample") == sample) & (F.col("hap") == hap) & (F.col("seq_id") == seq_id))
    for column, v in (("seq_start", seq_start), ("seq_end", seq_end)):
        if v is not None:
            found = found.where(F.col(column) == v)
    n = len(found.select("path_id").limit(2).collect())
    if n != 1:
        raise ValueError("no such walk" if n == 0 else "several walks match; give their coordinates")
    return found
