"""The commands as functions over a graph or a stored index."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import parse_gap, parse_region, reverse_complement
from .operators import communities, emit, haplotypes, subpaths, tracks, traverse, validate
from .operators.prefix import checkpoints, located
from .plans.lineage import cut
from .sources import gfa, store
from .sources.gfa import Graph


def index_graph(spark: SparkSession, source: str, out: str, paths: bool = True, checkpoint_steps: int = 4096, max_chunk_nodes: int = 0, min_chunk_nodes: int = 0, assignment: DataFrame | None = None) -> None:
    """Read graph text, check it, assign communities (detected, or those given) and write the index to a new folder."""
    if checkpoint_steps <= 0:
        raise ValueError("checkpoint_steps must be positive")
    if max_chunk_nodes and min_chunk_nodes > max_chunk_nodes:
        raise ValueError("min_chunk_nodes exceeds max_chunk_nodes")
    g = gfa.read_graph(spark, source)
    validate.check(g)
    if assignment is None:
        assignment = communities.add_singletons(communities.detect(g.links), g.segments, g.links)
        assignment = communities.refine_oversized(assignment, g.links, max_chunk_nodes)
        assignment = communities.merge_undersized(assignment, g.links, min_chunk_nodes, max_chunk_nodes)
    g.communities = assignment
    if not paths:
        g.paths, g.steps = g.paths.limit(0), g.steps.limit(0)
    steps = located(g.steps, g.segments)
    store.save(g, out, steps, checkpoints=checkpoints(steps, checkpoint_steps) if paths else None)


class GenomeGraph:
    """A graph with its queries. Results are DataFrames; text results have the columns section, part, ordinal, line."""

    def __init__(self, graph: Graph, tracks: tuple[DataFrame, DataFrame] | None = None):
        self.graph, self.tracks = graph, tracks
        self.steps = graph.steps if "s0" in graph.steps.columns else cut(located(graph.steps, graph.segments))

    @classmethod
    def load(cls, spark: SparkSession, path: str, with_tracks: bool = False) -> GenomeGraph:
        return cls(store.load(spark, path), store.load_tracks(spark, path) if with_tracks else None)

    @classmethod
    def read(cls, spark: SparkSession, source: str) -> GenomeGraph:
        return cls(gfa.read_graph(spark, source))

    # --- queries

    def get_chunk(self, community_id: int | None = None, node: str | None = None) -> DataFrame:
        return store.fetch_community(self.graph, community_id, node)

    def get_subgraph(self, start: str | list[str] | DataFrame, max_nodes: int = 100, paths: bool = True, with_coords: bool = False) -> DataFrame:
        """Lines of the neighbourhood of the start nodes."""
        spark = self.graph.segments.sparkSession
        seeds = start if isinstance(start, DataFrame) else spark.createDataFrame([(x,) for x in ([start] if isinstance(start, str) else start)], "node string")
        nodes = traverse.bfs(self.graph.links, seeds, max_nodes, nodes=self.graph.segments).select("node")
        if with_coords and not paths:
            raise ValueError("coordinates belong to paths")
        return emit.subgraph_lines(self.graph, nodes, located_steps=self.steps if with_coords else None, paths=paths)

    def get_path(self, name: str | None = None, walk: tuple | None = None, nodes: DataFrame | None = None, with_coords: bool = False, list_names: bool = False) -> DataFrame:
        """Lines by exactly one of: list_names, a name, a walk (sample, hap, seq_id[, start[, end]]), a set of nodes."""
        if sum((list_names, name is not None, walk is not None, nodes is not None)) != 1:
            raise ValueError("choose one way to select paths")
        if with_coords and nodes is None:
            raise ValueError("coordinates go with a set of nodes")
        if list_names:
            return emit.list_paths(self.graph.paths)
        if nodes is not None:
            runs = subpaths.node_runs(self.graph.steps, nodes)
            if runs.isEmpty():
                raise ValueError("no path has two steps in a row on these nodes")
            return subpaths.located_subpath_lines(self.graph.paths, self.steps, runs) if with_coords else subpaths.subpath_lines(self.graph.paths, self.graph.steps, runs)
        one = emit.find_path(self.graph.paths, name) if name is not None else emit.find_walk(self.graph.paths, *walk)
        path_id = one.first().path_id
        return subpaths.full_lines(one, self.graph.steps.where(F.col("path_id") == path_id))

    def index_coordinates(self, reference: str | None = None, selection: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        validate.check(self.graph, coordinates=True)
        self.tracks = tracks.build_tracks(self.graph, reference, selection, self.steps)
        return self.tracks

    def list_coordinates(self) -> DataFrame:
        counts = self.graph.steps.groupBy("path_id").agg(F.count("*").alias("step_count"))
        return tracks.list_coordinates(self.graph.paths, self.tracks[0] if self.tracks else None, counts)

    def get_region(self, region: str, reference: str | None = None, all_haplotypes: bool = False, haplotype_gap: str | None = None, max_nodes: int = 10_000, paths: bool = True, with_coords: bool = False) -> tuple[DataFrame, list[str]]:
        """(lines, warnings) of a region: its nodes' neighbourhood, or all paths that share nodes with it."""
        gap = parse_gap(haplotype_gap)
        if gap is not None and not all_haplotypes:
            raise ValueError("--haplotype_gap requires --all_haplotypes")
        slices, warnings = self.region_slices(region, reference)
        if not all_haplotypes:
            return self.get_subgraph(slices.select("node").distinct(), max_nodes, paths, with_coords), warnings
        runs = haplotypes.haplotype_runs(self.steps, slices.where("path_id is not null"), gap) if not slices.where("path_id is not null").isEmpty() else self._shared_runs(slices, gap)
        nodes = haplotypes.run_nodes(self.graph.steps, runs).unionByName(slices.select("node")).distinct()
        return emit.subgraph_lines(self.graph, nodes, runs, self.steps if with_coords else None, paths), warnings

    def _shared_runs(self, slices: DataFrame, gap: int | None) -> DataFrame:
        """Segment tracks have no path of their own: every path that visits their nodes counts."""
        anchors = self.steps.join(slices.select("node").distinct(), "node", "left_semi")
        if gap is None:
            return haplotypes.anchor_bounds(anchors).select("path_id", F.col("first").alias("start_step"), (F.col("last") - F.col("first") + 1).alias("step_count"))
        return haplotypes.cluster_runs(anchors, gap)

    def region_slices(self, region: str, reference: str | None = None) -> tuple[DataFrame, list[str]]:
        sequence, begin, end = parse_region(region)
        t, e = self.tracks if self.tracks else (None, None)
        return tracks.region(self.graph, sequence, begin, end, reference, t, e, self.steps)

    # --- the object interface

    def __len__(self) -> int:
        return self.graph.segments.count()

    def __contains__(self, node: str) -> bool:
        return not self.graph.segments.where(F.col("node") == node).limit(1).isEmpty()

    def __getitem__(self, node: str):
        rows = self.graph.segments.where(F.col("node") == node).limit(1).collect()
        return rows[0] if rows else None

    def __str__(self) -> str:
        return f"GenomeGraph with {len(self)} nodes of {self.total_length()} bases"

    def total_length(self) -> int:
        return self.graph.segments.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]

    def node_community(self, node: str) -> int | None:
        return store.community_of(self.graph, node)

    def node_line(self, node: str, sequence: bool = True) -> str | None:
        """The S line of a node; * for a sequence that is empty or not wanted."""
        s = self[node]
        if s is None:
            return None
        tags = [f"{k}:{v}" for k, v in (s.tags or {}).items()]
        return "\t".join(["S", node, s.seq if sequence and s.seq else "*", *tags])

    def neighbours(self, node: str) -> list[str]:
        return [r.nbr for r in traverse.neighbours(self.graph.links, node).collect()]

    def children(self, node: str, direction: int) -> list[tuple[str, str]]:
        return sorted((r.nbr, r.nbr_side) for r in traverse.children(self.graph.links, node, direction).collect())

    def _walk_steps(self, walk: str) -> DataFrame:
        spark = self.graph.segments.sparkSession
        return gfa.parse_steps(gfa.parse_path_lines(gfa.records_of(spark, [f"W\t_\t0\t_\t*\t*\t{walk}"])))

    def path_exists(self, walk: str) -> bool:
        """Whether all consecutive oriented steps of a walk such as >a<b are links."""
        return traverse.missing_edges(self._walk_steps(walk), self.graph.links).isEmpty()

    def path_sequence(self, walk: str) -> str:
        rows = traverse.path_sequences(self._walk_steps(walk), self.graph.segments, reverse_complement).collect()
        return rows[0].sequence if rows else ""

    def remove_nodes(self, nodes: list[str]) -> GenomeGraph:
        gone = self.graph.segments.sparkSession.createDataFrame([(n,) for n in nodes], "node string")
        s, links = traverse.remove_nodes(self.graph.links, self.graph.segments, gone)
        return GenomeGraph(Graph(s, links, self.graph.paths, self.graph.steps, self.graph.headers, self.graph.communities), self.tracks)

    def bfs(self, start: str, size: int = 100, mode: str = "discover") -> list[str]:
        """Node names in the order found. mode 'dequeue' counts a node when it is expanded, as a plain queue search does: it looks
        up one node's neighbours at a time and is meant for small sizes."""
        if mode == "discover":
            seeds = self.graph.segments.sparkSession.createDataFrame([(start,)], "node string")
            return [r.node for r in traverse.bfs(self.graph.links, seeds, size, nodes=self.graph.segments).orderBy("position").collect()]
        if start not in self:
            raise ValueError(f"unknown node {start!r}")
        seen, todo, out = {start}, deque([start]), []
        while todo and len(out) < size:
            node = todo.popleft()
            out.append(node)
            for n in self.neighbours(node):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return out

    def write(self, path: str) -> int:
        return emit.write_file(emit.whole_graph_lines(self.graph), path)
