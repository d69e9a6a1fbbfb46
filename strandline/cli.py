"""Command line: python -m strandline.cli COMMAND ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import graph as G
from .operators import emit
from .sources import gfa


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandline")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for x in positional:
            p.add_argument(x)
        return p

    p = command("index_gfa", "gfa", "out")
    p.add_argument("--no_paths", action="store_true")
    for name, default in (("checkpoint_steps", 4096), ("max_chunk_nodes", 0), ("min_chunk_nodes", 0)):
        p.add_argument(f"--{name}", type=int, default=default)
    p = command("get_chunk", "index")
    p.add_argument("--community_id", type=int)
    p.add_argument("--node_id")
    p = command("get_subgraph", "index", "start_node", "out")
    p.add_argument("--max_nodes", type=int, default=100)
    p.add_argument("--no_paths", action="store_true")
    p.add_argument("--with_coords", action="store_true")
    command("index_paths", "gfa", "out")
    p = command("index_path_checkpoints", "index", "out")
    p.add_argument("--checkpoint_steps", type=int, default=4096)
    p = command("get_path", "index")
    p.add_argument("--path_id")
    p.add_argument("--print_path_names", action="store_true")
    for name in ("sample", "seq_id", "nodes", "nodes_file", "subgraph_gfa"):
        p.add_argument(f"--{name}")
    for name in ("hap_index", "seq_start", "seq_end"):
        p.add_argument(f"--{name}", type=int)
    p.add_argument("--with_walk_coords", action="store_true")
    p = command("index_coordinates", "index", "out")
    p.add_argument("--reference")
    p.add_argument("--path_names_file")
    p = command("get_region", "index")
    p.add_argument("region", nargs="?")
    p.add_argument("out", nargs="?")
    p.add_argument("--print_path_names", "--list_coordinates", action="store_true", help="list what can be queried, and stop")
    p.add_argument("--no_header", action="store_true")
    p.add_argument("--reference")
    p.add_argument("--tracks", help="folder that index_coordinates wrote")
    p.add_argument("--max_nodes", type=int, default=10_000)
    p.add_argument("--all_haplotypes", action="store_true")
    p.add_argument("--haplotype_gap")
    p.add_argument("--no_paths", action="store_true")
    p.add_argument("--with_coords", action="store_true")
    p = command("list_coordinates", "index")
    p.add_argument("--tracks")
    p.add_argument("--no_header", action="store_true")
    p = command("bfs", "index", "node")
    p.add_argument("size", type=int, nargs="?", default=100)
    p.add_argument("--out", help="write the subgraph of the nodes found to this file instead of listing them")
    return top


def _list_coordinates(g: G.GenomeGraph, header: bool) -> None:
    df = g.list_coordinates()
    if header:
        print("\t".join(df.columns))
    for row in df.orderBy(*df.columns[:5]).toLocalIterator():
        print("\t".join("" if x is None else str(x) for x in row))


def _show(df, *order: str) -> None:
    for row in df.orderBy(*order).select("line").toLocalIterator():
        print(row.line)


def _loaded(spark: SparkSession, a: argparse.Namespace) -> G.GenomeGraph:
    g = G.GenomeGraph.load(spark, a.index)
    if getattr(a, "tracks", None):
        g.tracks = (spark.read.parquet(f"{a.tracks}/tracks"), spark.read.parquet(f"{a.tracks}/entries"))
    return g


def run(spark: SparkSession, argv: list[str]) -> int:
    a = parser().parse_args(argv)
    if a.command == "index_gfa":
        G.index_graph(spark, a.gfa, a.out, not a.no_paths, a.checkpoint_steps, a.max_chunk_nodes, a.min_chunk_nodes)
    elif a.command == "index_paths":
        lines = gfa.parse_path_lines(gfa.read_records(spark, a.gfa))
        gfa.parse_paths(lines).write.mode("error").parquet(f"{a.out}/paths")
        gfa.parse_steps(lines).repartitionByRange("path_id", "step_rank").sortWithinPartitions("path_id", "step_rank").write.mode("error").parquet(f"{a.out}/steps")
    elif a.command == "index_path_checkpoints":
        G.checkpoints(_loaded(spark, a).steps, a.checkpoint_steps).write.mode("error").parquet(a.out)
    elif a.command == "get_chunk":
        _show(_loaded(spark, a).get_chunk(a.community_id, a.node_id).withColumn("k", F.col("kind") == "L"), "k", "ordinal")
    elif a.command == "get_subgraph":
        emit.write_file(_loaded(spark, a).get_subgraph(a.start_node, a.max_nodes, not a.no_paths, a.with_coords), a.out)
    elif a.command == "get_path":
        g = _loaded(spark, a)
        nodes = None
        if a.nodes or a.nodes_file or a.subgraph_gfa:
            segments = gfa.parse_segments(gfa.read_records(spark, a.subgraph_gfa)) if a.subgraph_gfa else None
            nodes = gfa.node_list(spark, a.nodes, a.nodes_file, segments)
        walk = (a.sample, a.hap_index, a.seq_id, a.seq_start, a.seq_end) if a.sample is not None else None
        if walk and (a.hap_index is None or a.seq_id is None):
            raise ValueError("a walk needs sample, hap_index and seq_id")
        df = g.get_path(a.path_id, walk, nodes, a.with_walk_coords, a.print_path_names)
        _show(df, *[c for c in ("path_id", "start_step") if c in df.columns])
    elif a.command == "index_coordinates":
        g = _loaded(spark, a)
        chosen = gfa.path_selection(gfa.read_records(spark, a.path_names_file), g.graph.paths) if a.path_names_file else None
        t, e = g.index_coordinates(a.reference, chosen)
        t.write.mode("error").parquet(f"{a.out}/tracks")
        e.repartitionByRange("track_id", "start").sortWithinPartitions("track_id", "start").write.mode("error").parquet(f"{a.out}/entries")
    elif a.command == "get_region" and a.print_path_names:
        _list_coordinates(_loaded(spark, a), not a.no_header)
    elif a.command == "get_region":
        if not a.region or not a.out:
            raise ValueError("give a region and an output file")
        lines, warnings = _loaded(spark, a).get_region(a.region, a.reference, a.all_haplotypes, a.haplotype_gap, a.max_nodes, not a.no_paths, a.with_coords)
        for w in warnings:
            print(f"warning: {w}", file=sys.stderr)
        emit.write_file(lines, a.out)
    elif a.command == "list_coordinates":
        _list_coordinates(_loaded(spark, a), not a.no_header)
    elif a.command == "bfs":
        g = _loaded(spark, a)
        found = g.bfs(a.node, a.size)
        if a.out:
            nodes = spark.createDataFrame([(n,) for n in found], "node string")
            emit.write_file(emit.subgraph_lines(g.graph, nodes, paths=False), a.out)
        else:
            print("\n".join(found))
    return 0


def main() -> int:
    spark = SparkSession.builder.appName("strandline").getOrCreate()
    try:
        return run(spark, sys.argv[1:])
    except ValueError as error:
        print(f"error: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
