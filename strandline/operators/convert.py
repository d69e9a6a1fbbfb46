"""Conversions, statistics and consistency checks of graph files."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .communities import simple_edges


def record_stats(records: DataFrame) -> DataFrame:
    """(record, n, bytes): lines by type S L P W H or other; bytes count the line break."""
    kind = F.when(F.col("value").rlike("^[SLPWH](\t|$)"), F.substring("value", 1, 1)).otherwise("other")
    return records.groupBy(kind.alias("record")).agg(F.count("*").alias("n"), F.sum(F.octet_length("value") + 1).cast("long").alias("bytes"))


def walks_to_paths(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths with walks as P paths, mapping). A walk is named sample#hap#seq[:start-end]; both coordinates are known or neither,
    and the start comes first; a name that occurs twice is an error; tags stay and overlaps are unknown."""
    w = F.col("record_type") == "W"
    base = F.concat_ws("#", "sample", F.col("hap").cast("string"), "seq_id")
    bad = w & ((F.col("seq_start").isNull() != F.col("seq_end").isNull()) | (F.col("seq_start") >= F.col("seq_end")))
    named = F.when(F.col("seq_start").isNull(), base).otherwise(F.concat(base, F.lit(":"), F.col("seq_start"), F.lit("-"), F.col("seq_end")))
    d = paths.withColumn("p_path_name", F.when(bad, F.raise_error(F.concat(F.lit("walk with bad coordinates: "), F.col("name"))).cast("string")).when(w, named).otherwise(F.col("name")))
    twice = d.groupBy("p_path_name").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate path name {twice[0].p_path_name!r}")
    star = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("*"))
    mapping = d.where(w).select("path_id", "sample", F.col("hap").alias("haplotype"), "seq_id", star("seq_start").alias("seq_start"), star("seq_end").alias("seq_end"), F.concat_ws("#", "sample", F.col("hap").cast("string"), "seq_id").alias("walk_name"), "p_path_name")
    null = lambda t: F.lit(None).cast(t)
    out = d.select("path_id", F.lit("P").alias("record_type"), F.col("p_path_name").alias("name"), F.when(w, "*").otherwise(F.col("overlaps")).alias("overlaps"), "tags", null("string").alias("sample"), null("long").alias("hap"), null("string").alias("seq_id"), null("long").alias("seq_start"), null("long").alias("seq_end"))
    return out, mapping


def converted_headers(headers: DataFrame) -> DataFrame:
    """Headers with version 1.0, which has P paths only."""
    return headers.withColumn("raw", F.regexp_replace("raw", "(\tVN:Z:)[^\t]*", "$11.0"))


def metis(links: DataFrame, segments: DataFrame) -> tuple[str, DataFrame]:
    """(header 'n m', (id, node, line)): nodes numbered from 1 by name; a line lists the neighbours' numbers in order, without self-loops and repeats."""
    from ..sources.gfa import dense_index

    nodes = segments.select("node").distinct().orderBy("node").withColumn("_o", F.monotonically_increasing_id())
    nodes = dense_index(nodes, "_o", "id").select("node", (F.col("id") + 1).alias("id"))
    e = simple_edges(links).where("u <> v")
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.join(nodes.select(F.col("node").alias("v"), "id"), "v").groupBy(F.col("u").alias("node")).agg(F.array_join(F.array_sort(F.collect_set("id")), " ").alias("line"))
    return f"{nodes.count()} {e.count()}", nodes.join(near, "node", "left").select("id", "node", F.coalesce("line", F.lit("")).alias("line"))


def adjacency(links: DataFrame) -> DataFrame:
    """(node, n, neighbours): distinct other neighbours in order of their names."""
    e = simple_edges(links).where("u <> v")
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("v")), " ").alias("neighbours"))


def path_loops(steps: DataFrame, first: int = 5) -> DataFrame:
    """(path_id, n_steps, n_unique, n_repeated, extra_visits, first_repeats): nodes that a path visits more than once."""
    visits = steps.groupBy("path_id", "node").agg(F.count("*").alias("n"), F.min("step_rank").alias("at"))
    again = F.slice(F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.struct("at", "node")))), 1, first)
    return visits.groupBy("path_id").agg(F.sum("n").alias("n_steps"), F.count("*").alias("n_unique"), F.count(F.when(F.col("n") > 1, 1)).alias("n_repeated"), F.sum(F.col("n") - 1).alias("extra_visits"), F.array_join(F.transform(again, lambda x: x["node"]), ",").alias("first_repeats"))


def duplicate_names(paths: DataFrame) -> DataFrame:
    return paths.groupBy("record_type", "name").agg(F.count("*").alias("n")).where("n > 1")


def packed_step_bytes(n_steps: int, n_nodes: int, align: int = 1) -> int:
    """Bytes of steps packed as a node number and an orientation bit."""
    bits = max(1, max(n_nodes - 1, 0).bit_length()) + 1
    return ceil(ceil(n_steps * bits / 8) / align) * align


def size_breakdown(segments: DataFrame, links: DataFrame, paths: DataFrame, steps: DataFrame) -> DataFrame:
    """(section, rows, bytes) of fixed-width tables: steps of 4 bytes, postings of 12, nodes and paths with their names."""
    one = lambda df, name, size: df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes")).select(F.lit(name).alias("section"), "rows", "bytes")
    out = one(steps, "steps", F.lit(4)).unionByName(one(steps, "postings", F.lit(12)))
    out = out.unionByName(one(segments, "nodes", F.octet_length("node") + 20)).unionByName(one(paths, "paths", F.octet_length("name") + 40)).unionByName(one(links, "links", F.octet_length("src") + F.octet_length("dst") + 2))
    return out


def compare_nodes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n1, n2, shared): distinct nodes of two graphs."""
    both = a.select("node").distinct().withColumn("x", F.lit(1)).join(b.select("node").distinct().withColumn("y", F.lit(1)), "node", "full_outer")
    return both.agg(F.count("x").alias("n1"), F.count("y").alias("n2"), F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).alias("shared"))


def same_nodes(a: DataFrame, b: DataFrame) -> bool:
    return a.select("node").exceptAll(b.select("node")).isEmpty() and b.select("node").exceptAll(a.select("node")).isEmpty()


def resolve_loci(loci: DataFrame, walks: DataFrame) -> DataFrame:
    """loci(query_id, sample, hap, seq_id, position) joined to the one walk of their identity that contains the position.

    Adds the walk, the position in it and the number of walks that contain it: a locus is resolved iff that is 1.
    """
    w = walks.select("sample", "hap", "seq_id", "path_id", "seq_start", "seq_end")
    j = loci.join(w, ["sample", "hap", "seq_id"], "left").withColumn("_in", (F.col("position") >= F.col("seq_start")) & (F.col("position") < F.col("seq_end")))
    g = j.groupBy("query_id").agg(F.count(F.when(F.col("_in"), 1)).alias("n"), F.min(F.when(F.col("_in"), F.struct("path_id", (F.col("position") - F.col("seq_start")).alias("local"), "seq_start", "seq_end"))).alias("w"))
    return g.select("query_id", "n", F.when(F.col("n") == 1, F.col("w.path_id")).alias("path_id"), F.when(F.col("n") == 1, F.col("w.local")).alias("local_position"))


def local_region(start: int, end: int, seq_start: int, seq_end: int) -> tuple[int, int, int]:
    """A half-open region of a sequence in a fragment's own coordinates: (start, end, inclusive end). It must lie in the fragment."""
    if not seq_start <= start < end <= seq_end:
        raise ValueError("the region is not within the fragment")
    return start - seq_start, end - seq_start, end - seq_start - 1


def manifest_problems(loci: DataFrame, graphs: DataFrame) -> DataFrame:
    """(graph, query_id, problem) of loci(graph, query_id, sample, haplotype, seq_id, node_position, region_start, region_end)."""
    empty = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    one = lambda df, text: df.select("graph", "query_id", F.lit(text).alias("problem"))
    out = one(loci.join(graphs.select("graph").distinct(), "graph", "left_anti"), "unknown graph")
    out = out.unionByName(one(loci.groupBy("graph", "query_id").agg(F.count("*").alias("n")).where("n > 1"), "duplicate query"))
    out = out.unionByName(one(loci.where(empty("sample") | empty("haplotype") | empty("seq_id")), "empty identity"))
    out = out.unionByName(one(loci.where(empty("node_position") & empty("region_start") & empty("region_end")), "neither node nor region"))
    return out.unionByName(one(loci.where(empty("region_start") != empty("region_end")), "half a region"))


def select_names(paths: DataFrame, wanted: DataFrame) -> DataFrame:
    """P paths of wanted(ordinal, name) in that order; repeated and missing names are errors."""
    twice = wanted.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    missing = wanted.join(paths.where("record_type = 'P'"), "name", "left_anti").limit(1).collect()
    if twice or missing:
        raise ValueError(f"{'repeated' if twice else 'missing'} path name {(twice or missing)[0].name!r}")
    return paths.where("record_type = 'P'").join(wanted, "name").orderBy("ordinal")


def seed_node(segments: DataFrame) -> str:
    """The one segment of a seed file."""
    names = [r.node for r in segments.select("node").distinct().limit(2).collect()]
    if len(names) != 1:
        raise ValueError("a seed file holds exactly one segment")
    return names[0]


def random_paths(spark: SparkSession, segments: DataFrame, n_paths: int, n_steps: int, seed: int = 1) -> DataFrame:
    """Steps of random paths over the segments, for tests."""
    from ..sources.gfa import dense_index

    nodes = dense_index(segments.select("node").distinct().orderBy("node").withColumn("_o", F.monotonically_increasing_id()), "_o", "id").select("node", "id")
    n = nodes.count()
    s = spark.range(n_paths * n_steps).select(F.expr(f"id div {n_steps}").alias("path_id"), F.expr(f"id % {n_steps}").alias("step_rank"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).alias("pick"), (F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(2)) == 1).alias("is_reverse"))
    return s.join(nodes, s.pick == nodes.id).select("path_id", "step_rank", "node", "is_reverse")


def rollup_runs(runs: DataFrame, by: list[str], seconds: str = "seconds", memory: str = "peak_kb") -> DataFrame:
    """Mean seconds and largest memory of each group of runs."""
    return runs.groupBy(*by).agg(F.count("*").alias("n"), F.avg(seconds).alias("mean_seconds"), F.max(memory).alias("max_memory"))


def pivot_runs(runs: DataFrame, key: list[str], tool: str, tools: list[str], seconds: str = "seconds") -> DataFrame:
    """One row a parameter key, a column of mean seconds a tool."""
    return runs.groupBy(*key).pivot(tool, tools).agg(F.avg(seconds))


def latest(rows: DataFrame, key: str, at: str, value: str, baseline: DataFrame) -> DataFrame:
    """(key, latest, baseline, delta, percent): each key's value of the last time against baseline(key, baseline)."""
    last = rows.groupBy(key).agg(F.max_by(value, at).alias("latest"))
    return last.join(baseline, key).withColumn("delta", F.col("latest") - F.col("baseline")).withColumn("percent", F.when(F.col("baseline") != 0, 100.0 * F.col("delta") / F.col("baseline")))


def size_table(files: DataFrame, by: list[str], size: str = "bytes") -> DataFrame:
    """Bytes of each file and a TOTAL row for each group of all but the last column."""
    detail = files.groupBy(*by).agg(F.sum(size).alias("bytes"))
    total = files.groupBy(*by[:-1]).agg(F.sum(size).alias("bytes")).withColumn(by[-1], F.lit("TOTAL"))
    return detail.unionByName(total)


def locus_audit(loci: DataFrame, first_map: DataFrame, second_map: DataFrame) -> DataFrame:
    """loci(.., node) with the names two maps(node, name) give the node; missing ones stay null."""
    return loci.join(first_map.select("node", F.col("name").alias("first_name")), "node", "left").join(second_map.select("node", F.col("name").alias("second_name")), "node", "left")
