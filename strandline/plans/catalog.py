"""Registered queries over the driver tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import name_base, name_end, name_start, reverse_complement
from ..operators import communities as C
from ..operators import convert as V
from ..operators import emit as E
from ..operators import haplotypes as H
from ..operators import prefix as P
from ..operators import subpaths as S
from ..operators import tracks as T
from ..operators import traverse as X
from ..sources import gfa, store
from .lineage import cut
from .views import Views, consecutive_pairs, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(views: str = "", text: str | None = None):
    """Register a function of the views under its name, with SQL over the named SQL views."""

    def put(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if text is not None:
            SQL[f.__name__] = sql(views, text) if views else text
        return f

    return put


SIGN = "case when is_reverse then '-' else '+' end"
PICK = "p_partkey % 10 < 5"


def picked(v: Views) -> DataFrame:
    """Half of the nodes."""
    return v.segments.where(PICK).select("node")


# --- scans, records, paths -------------------------------------------------------------------------------------------


@query("a_seg", "select node, length from a_seg")
def segments_scan(v):
    return gfa.parse_segments(v.segments.select("ordinal", F.col("raw").alias("value"))).select("node", "length")


@query("a_link", "select src, src_orient, dst, dst_orient from a_link")
def links_scan(v):
    return gfa.parse_links(v.links.select("ordinal", F.col("raw").alias("value"))).select("src", "src_orient", "dst", "dst_orient")


@query("a_step", "select path_id, step_rank, node, is_reverse from a_step")
def steps_scan(v):
    lines = S.full_lines(v.paths, v.steps).select(F.col("path_id").alias("ordinal"), F.col("line").alias("value"))
    parsed = gfa.parse_path_lines(lines)
    order = gfa.parse_paths(parsed).select("path_id", F.substring("name", 2, 20).cast("long").alias("order"))
    return gfa.parse_steps(parsed).join(order, "path_id").select(F.col("order").alias("path_id"), "step_rank", "node", "is_reverse")


@query("w_path a_loc", f"select 'P' || chr(9) || 'o' || path_id || chr(9) || string_agg(node || {SIGN}, ',' order by step_rank) || chr(9) || '*' as line from a_step group by path_id union all select 'W' || chr(9) || c || chr(9) || '0' || chr(9) || c || chr(9) || seq_start || chr(9) || seq_end || chr(9) || string_agg(case when is_reverse then '<' else '>' end || node, '' order by step_rank) as line from a_step join w_path using (path_id) group by path_id, c, seq_start, seq_end")
def gfa_text_roundtrip(v):
    # Text is written once: counting the lines, paths and both kinds of steps read it.
    lines = S.full_lines(v.paths.unionByName(v.walks), v.steps)
    number = F.col("path_id") + F.when(F.col("line").startswith("W"), 1 << 40).otherwise(0)
    parsed = gfa.parse_path_lines(cut(lines.select(number.alias("ordinal"), F.col("line").alias("value"))))
    return S.full_lines(gfa.parse_paths(parsed), gfa.parse_steps(parsed)).select("line")


@query("a_seg a_link", f"with r as (select 'S' as record, 'S' || chr(9) || node || chr(9) || '*' || chr(9) || 'LN:i:' || length as line from a_seg union all select 'L', 'L' || chr(9) || src || chr(9) || src_orient || chr(9) || dst || chr(9) || dst_orient || chr(9) || '0M' from a_link union all select 'P', 'P' || chr(9) || 'o' || path_id || chr(9) || string_agg(node || {SIGN}, ',' order by step_rank) || chr(9) || '*' from a_step group by path_id) select record, count(*) as n, sum(strlen(line) + 1)::bigint as bytes from r group by record")
def record_stats(v):
    lines = v.segments.select(F.col("raw").alias("value")).unionByName(v.links.select(F.col("raw").alias("value"))).unionByName(S.full_lines(v.paths, v.steps).select(F.col("line").alias("value")))
    return V.record_stats(lines)


@query("a_step", "select path_id, 'o' || path_id as name, step_rank, node, is_reverse from a_step where path_id = (select min(path_id) from a_step)")
def path_lookup(v):
    name = v.steps.agg(F.concat(F.lit("o"), F.min("path_id")).alias("n")).first().n
    return E.find_path(v.paths, name).select("path_id", "name").join(v.steps, "path_id")


@query("w_path", "select path_id, seq_start, seq_end from w_path where path_id = (select min(path_id) from w_path)")
def walk_lookup(v):
    one = v.walks.orderBy("path_id").limit(1).first()
    return E.find_walk(v.walks, one.sample, 0, one.seq_id, one.seq_start).select("path_id", "seq_start", "seq_end")


@query("w_path", "select path_id, 'W' || chr(9) || c || chr(9) || '0' || chr(9) || c || chr(9) || seq_start || chr(9) || seq_end as line from w_path union all select distinct path_id, 'P' || chr(9) || 'o' || path_id from a_step")
def list_paths(v):
    return E.list_paths(v.walks.unionByName(v.paths))


@query("w_path", "select n as name, regexp_extract(n, '^(.*):([0-9]+)-([0-9]+)$', 1) as base, regexp_extract(n, '^(.*):([0-9]+)-([0-9]+)$', 2)::bigint as seq_start, regexp_extract(n, '^(.*):([0-9]+)-([0-9]+)$', 3)::bigint as seq_end from (select c || '#0:' || path_id || ':' || seq_start || '-' || seq_end as n from w_path)")
def p_name_coords(v):
    n = v.walks.select(F.concat("seq_id", F.lit("#0:"), "path_id", F.lit(":"), "seq_start", F.lit("-"), "seq_end").alias("name"))
    return n.select("name", name_base(F.col("name")).alias("base"), name_start(F.col("name")).alias("seq_start"), name_end(F.col("name")).alias("seq_end"))


@query("w_path a_total", "select 'c' as kind, c || '#0#' || c || ':' || seq_start || '-' || seq_end as p_path_name, path_id, '*' as overlaps from w_path")
def walk_to_path(v):
    out, _ = V.walks_to_paths(v.walks)
    return out.select(F.lit("c").alias("kind"), F.col("name").alias("p_path_name"), "path_id", "overlaps")


# --- communities -----------------------------------------------------------------------------------------------------


@query("a_comm a_link", "select 'S' as kind, node as a, '' as b from a_comm where community_id = 3 union all select 'L', src || src_orient, dst || dst_orient from a_link join a_comm x on src = x.node join a_comm y on dst = y.node where x.community_id = 3 and y.community_id = 3")
def chunk_fetch(v):
    got = store.fetch_community(v.graph, 3)
    f = F.split("line", "\t")
    link = F.col("kind") == "L"
    return got.select("kind", F.when(link, F.concat(f[1], f[2])).otherwise(f[1]).alias("a"), F.when(link, F.concat(f[3], f[4])).otherwise("").alias("b"))


@query("a_comm a_link", "select case when x.community_id = y.community_id then x.community_id else -1 end as community_id, count(*) as n from a_link join a_comm x on src = x.node join a_comm y on dst = y.node group by 1")
def chunk_edges(v):
    return C.classify_links(v.links, v.communities).groupBy(F.col("community_id").cast("long").alias("community_id")).agg(F.count("*").alias("n"))


@query("a_comm", "select community_id, count(*) as size from a_comm group by 1")
def community_sizes(v):
    return C.sizes(v.communities)


@query("a_comm", "with s as (select p_brand, count(*) as size from a_seg group by 1) select count(*) as n, min(size) as least, median(size)::double as median, avg(size)::double as mean, max(size) as most from s")
def community_stats(v):
    return C.size_stats(C.sizes(v.segments.select("node", F.col("p_brand").alias("community_id"))))


@query("a_comm", "with s as (select p_brand, count(*) as size from a_seg group by 1) select (floor(size / 5.0) * 5)::bigint as bin_start, count(*) as n from s group by 1")
def size_histogram(v):
    return C.size_histogram(C.sizes(v.segments.select("node", F.col("p_brand").alias("community_id"))), 5)


@query("a_comm a_edge", "with e as (select x.community_id as a, y.community_id as b from a_edge join a_comm x on u = x.node join a_comm y on v = y.node where x.community_id <> y.community_id) select a as community_id, b as neighbour, count(*) as weight from (select a, b from e union all select b, a from e) group by 1, 2")
def quotient_edges(v):
    return C.quotient(v.links, v.communities)


@query("a_seg a_step", "select node from a_seg where p_partkey % 3 = 0 and node not in (select src from a_link where substr(src, 2)::bigint % 3 <> 0 union select dst from a_link where substr(dst, 2)::bigint % 3 <> 0)".replace("a_link where", "(select node as src, lead(node) over (partition by path_id order by step_rank) as dst from a_step) where dst is not null and"))
def singletons(v):
    other = lambda c: F.substring(c, 2, 20).cast("long") % 3 != 0
    src, dst = v.links.where(other("src")).select("src", F.col("src").alias("dst")), v.links.where(other("dst")).select(F.col("dst").alias("src"), "dst")
    return C.singletons(v.segments.where("p_partkey % 3 = 0"), src.unionByName(dst))


@query("a_seg a_edge", "with c as (select node, p_partkey % 97 as community_id from a_seg), s as (select community_id, count(*) as size from c group by 1) select community_id, size from s where size < (select avg(size) from s)")
def undersized(v):
    s = C.sizes(v.segments.select("node", (F.col("p_partkey") % 97).alias("community_id")))
    return s.join(F.broadcast(s.agg(F.avg("size").alias("m"))), F.col("size") < F.col("m")).select("community_id", "size")


@query("a_seg a_edge", "with c as (select node, p_partkey % 97 as community_id from a_seg), s as (select community_id, count(*) as size from c group by 1), e as (select x.community_id as a, y.community_id as b from a_edge join c x on u = x.node join c y on v = y.node where x.community_id <> y.community_id), q as (select a, b, count(*) as weight from (select a, b from e union all select b, a from e) group by 1, 2), r as (select a, s.size, b, weight, row_number() over (partition by a order by weight desc, s.size + o.size, b) as k from q join s on a = s.community_id join s o on b = o.community_id where s.size < 1000) select a as community_id, size, b as target, weight from r where k = 1")
def merge_candidates(v):
    return C.first_merges(v.links, v.segments.select("node", (F.col("p_partkey") % 97).alias("community_id")), 1000)


@query()
def merged_communities(v):
    c = v.segments.select("node", (F.col("p_partkey") % 97).alias("community_id"))
    return C.sizes(C.merge_undersized(c, v.links, 25, 60))


@query()
def detected_communities(v):
    links = cut(C.simple_edges(v.links).select(F.col("u").alias("src"), F.col("v").alias("dst")))
    return C.sizes(C.add_singletons(C.detect(links), v.segments, links))


@query()
def refined_communities(v):
    return C.sizes(C.refine_oversized(v.segments.select("node", (F.col("p_partkey") % 2).alias("community_id")), v.links, 50))


@query("a_comm a_edge", "with e as (select x.community_id as a, y.community_id as b from a_edge join a_comm x on u = x.node join a_comm y on v = y.node), m as (select count(*) as m from e), i as (select a as c, count(*) as i from e where a = b group by 1), t as (select c, count(*) as t from (select a as c from e union all select b from e) group by 1) select round(sum(coalesce(i, 0) / m - (t / (2.0 * m)) * (t / (2.0 * m))), 9) as modularity from t left join i using (c), m")
def modularity(v):
    return v.spark.createDataFrame([(round(C.modularity(v.links, v.communities), 9),)], "modularity double")


@query("a_comm", "select community_id, 'Community_' || community_id || ': ' || string_agg(node, ' ' order by node) as line from a_comm group by 1")
def community_listing(v):
    return C.listing(v.communities)


# --- postings, runs, prefix sums -------------------------------------------------------------------------------------


@query("a_seg a_step", f"select path_id, step_rank, node, is_reverse from a_step where node in (select node from a_seg where {PICK})")
def node_postings(v):
    return S.postings(v.steps, picked(v)).select("path_id", "step_rank", "node", "is_reverse")


@query("a_step", "select node, count(*) as n from a_step group by 1")
def posting_counts(v):
    return v.steps.groupBy("node").agg(F.count("*").alias("n"))


RUNS = f"runs as (select path_id, min(step_rank) as start_step, count(*) as step_count from (select path_id, step_rank, step_rank - row_number() over (partition by path_id order by step_rank) as g from a_step where node in (select node from a_seg where {PICK})) group by path_id, g having count(*) >= 2)"


@query("a_seg a_step", f"with {RUNS} select path_id, start_step, step_count from runs")
def node_subpaths(v):
    return S.node_runs(v.steps, picked(v))


@query("a_loc", f"with {RUNS} select path_id, start_step, 'P' || chr(9) || 'o' || path_id || ':' || min(s0) || '-' || max(s1) || chr(9) || string_agg(node || {SIGN}, ',' order by step_rank) || chr(9) || '*' as line from runs join a_loc using (path_id) where step_rank >= start_step and step_rank < start_step + step_count group by path_id, start_step")
def node_subpaths_coords(v):
    return S.located_lines(v.paths, S.posting_runs(v.located, picked(v))).select("path_id", "start_step", "line")


@query("a_loc w_path", f"with {RUNS} select path_id, start_step, 'W' || chr(9) || c || chr(9) || '0' || chr(9) || c || '#subpath_' || start_step || '_' || (start_step + step_count - 1) || chr(9) || '*' || chr(9) || '*' || chr(9) || string_agg(case when is_reverse then '<' else '>' end || node, '' order by step_rank) as line from runs join a_step using (path_id) join w_path using (path_id) where step_rank >= start_step and step_rank < start_step + step_count group by path_id, start_step, step_count, c")
def walk_subpaths(v):
    return S.subpath_lines(v.walks, v.steps, S.node_runs(v.steps, picked(v)))


@query("a_seg a_step", f"with {RUNS}, o as (select path_id, string_agg((step_rank % 7) || 'M', ',' order by step_rank) filter (where step_rank > 0) as ov from a_step group by 1) select path_id, start_step, array_to_string(list_slice(string_split(ov, ','), start_step + 1, start_step + step_count - 1), ',') as cut from runs join o using (path_id)")
def subpath_overlaps(v):
    o = v.steps.where("step_rank > 0").groupBy("path_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("step_rank")), lambda r: F.concat((r % 7).cast("string"), F.lit("M"))), ",").alias("overlaps"))
    return S.node_runs(v.steps, picked(v)).join(o, "path_id").select("path_id", "start_step", S.slice_overlaps(F.col("overlaps"), F.col("start_step"), F.col("step_count")).alias("cut"))


@query("a_step", "with r as (select path_id, step_rank as s, step_rank + 1 + path_id % 3 as e from a_step where (step_rank + path_id) % 2 = 0), m as (select *, case when s <= max(e) over (partition by path_id order by s rows between unbounded preceding and 1 preceding) then 0 else 1 end as n from r), i as (select *, sum(n) over (partition by path_id order by s) as g from m) select path_id, min(s) as start_step, (max(e) - min(s))::bigint as step_count from i group by path_id, g")
def merged_runs(v):
    r = v.steps.where("(step_rank + path_id) % 2 = 0").select("path_id", F.col("step_rank").alias("start_step"), (F.col("path_id") % 3 + 1).alias("step_count"))
    return S.merge_runs(r)


@query("a_loc", "select path_id, step_rank, s0, s1 from a_loc")
def prefix_lengths(v):
    return v.located.select("path_id", "step_rank", "s0", "s1")


@query("b_loc", "select path_id, step_rank // 4 as checkpoint_index, s0 as cumulative from b_loc where step_rank % 4 = 0 union select path_id, (step_rank + 1) // 4, s1 from b_loc where (step_rank + 1) % 4 = 0")
def checkpoints(v):
    return P.checkpoints(v.event_located, 4)


@query("b_loc", "select path_id, step_rank as step, s0 as cumulative from b_loc where step_rank % 5 = 3")
def checkpoint_lookup(v):
    points = v.event_steps.where("step_rank % 5 = 3").select("path_id", F.col("step_rank").alias("step"))
    return P.length_before(v.event_located, P.checkpoints(v.event_located, 4), points, 4)


@query("a_total", "select path_id, n as step_count, total as total_length from a_total")
def path_lengths(v):
    return P.total_lengths(P.with_lengths(v.steps, v.segments))


@query("a_step", "select path_id, sum(n)::bigint as n_steps, count(*) as n_unique, count(*) filter (n > 1) as n_repeated, sum(n - 1)::bigint as extra_visits from (select path_id, node, count(*) as n from b_ev group by all) group by 1".replace("b_ev", "(select user_id as path_id, event_type || ':' || least(floor(value / 25), 9)::bigint as node from events)"))
def path_loops(v):
    return V.path_loops(v.event_steps).drop("first_repeats")


# --- coordinates -----------------------------------------------------------------------------------------------------


def walk_tracks(v: Views, sequence: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Tracks and entries of all walks, or of those on one sequence: then only their steps are measured."""
    walks, steps = v.walks, v.located
    if sequence is not None:
        walks, steps = _on_sequence(v, sequence)
    placed = T.placed_paths(walks)
    entries = T.path_entries(steps, placed)
    n = entries.groupBy("path_id").agg(F.count("*").alias("entry_count"))
    tracks = placed.join(n, "path_id").select(F.col("path_id").alias("track_id"), "source_type", "name", *T.KEY, "seq_start", "seq_end", "entry_count")
    return tracks, entries.withColumnRenamed("path_id", "track_id")


@query("a_loc w_path", 'select path_id as track_id, step_rank as step, seq_start + s0 as start, seq_start + s1 as "end", node from a_loc join w_path using (path_id)')
def coord_entries(v):
    tracks, entries = walk_tracks(v)
    return T.ends_from_starts(entries.drop("end"), tracks)


@query("w_path", "select path_id as track_id, 'W' as source_type, c as reference, c as sequence, 0::bigint as haplotype, seq_start, seq_end, n as entry_count from w_path")
def coord_tracks(v):
    return walk_tracks(v)[0].drop("name")


@query("r_frag", 'select sequence, fragment, min(start) as seq_start, max("end") as seq_end, count(*) as entry_count from r_frag group by 1, 2')
def rgfa_fragments(v):
    return T.rgfa_tracks(T.rgfa_fragments(v.rgfa))


@query("w_path", "with t as (select path_id, c, greatest(seq_start - path_id % 2, 0) as seq_start, seq_end from w_path) select path_id as track_id, previous_end from (select path_id, seq_start, max(seq_end) over (partition by c order by seq_start, seq_end rows between unbounded preceding and 1 preceding) as previous_end from t) where seq_start < previous_end")
def track_overlap_check(v):
    t = walk_tracks(v)[0].withColumn("seq_start", F.greatest(F.col("seq_start") - F.col("track_id") % 2, F.lit(0)))
    return T.overlapping_tracks(t).select("track_id", "previous_end")


FIRST = "(select min(c) from w_path)"


def _first_sequence(v: Views) -> str:
    return v.walks.agg(F.min("seq_id").alias("s")).first().s


def _on_sequence(v: Views, sequence: str) -> tuple[DataFrame, DataFrame]:
    """The walks on a sequence and their located steps, written once: a region query reads them many times."""
    one = v.on_sequence(sequence)
    return one.walks, one.located


@query("a_loc w_path", f"select distinct path_id as track_id, step_rank as step, node from a_loc join w_path using (path_id) where c = {FIRST} and seq_start + s0 < 400 and seq_start + s1 > 90")
def region_nodes(v):
    name = _first_sequence(v)
    tracks, entries = walk_tracks(v, name)
    return T.region_entries(tracks, entries, name, 90, 400).select("track_id", "step", "node")


@query("a_loc w_path", f"select path_id, step_rank as step, seq_start + s0 as start, seq_start + s1 as \"end\", node from a_loc join w_path using (path_id) where c = {FIRST} and seq_start + s0 < 400 and seq_start + s1 > 90")
def region_nodes_onthefly(v):
    name = _first_sequence(v)
    return T.region_on_the_fly(*_on_sequence(v, name), name, 90, 400)


@query("r_frag", "select node, start from r_frag where sequence = (select min(sequence) from r_frag) and start < 150 and \"end\" > 40")
def region_segments(v):
    f = T.rgfa_fragments(v.rgfa)
    name = f.agg(F.min("sequence").alias("s")).first().s
    return f.where((F.col("sequence") == name) & T.overlaps(F.col("start"), F.col("end"), 40, 150)).select("node", "start")


@query("w_path", "select 'W' as source, c as reference, 0::bigint as haplotype, c as sequence, seq_start::varchar as start, seq_end::varchar as \"end\", case when path_id % 3 = 1 then n + 1 else n end as entries, case when path_id % 3 = 0 then 'on_the_fly' when path_id % 3 = 1 then 'stale_cdx' else 'cdx' end as coordinate_access from w_path")
def list_coordinates(v):
    tracks = walk_tracks(v)[0].where("track_id % 3 <> 0")
    stale = tracks.withColumn("entry_count", F.when(F.col("track_id") % 3 == 1, F.col("entry_count") + 1).otherwise(F.col("entry_count")))
    counts = v.steps.groupBy("path_id").agg(F.count("*").alias("step_count"))
    return T.list_coordinates(v.walks, stale, counts)


# --- all haplotypes of a region --------------------------------------------------------------------------------------

REGION = (10, 60)
_REF = f"ref as (select * from b_loc where path_id = (select min(path_id) from b_loc) and s0 < {REGION[1]} and s1 > {REGION[0]}), an as (select * from b_loc where node in (select node from ref) and path_id not in (select path_id from ref))"
_SHOW = f"select path_id, 'u' || path_id || ':' || min(s0) || '-' || max(s1) as name, string_agg(node || {SIGN}, ',' order by step_rank) as steps from runs join b_loc using (path_id) where step_rank between a and z group by path_id, a"
_DEFAULT = f"with {_REF}, runs as (select path_id, min(step_rank) as a, max(step_rank) as z from ref group by 1 union all select path_id, min(step_rank), max(step_rank) from an group by 1)"


def _gap_runs(gap: int) -> str:
    return f"with {_REF}, mk as (select path_id, step_rank, case when s0 - lag(s1) over (partition by path_id order by step_rank) > {gap} then 1 else 0 end as nb from an), cl as (select path_id, step_rank, sum(nb) over (partition by path_id order by step_rank) as c from mk), runs as (select path_id, min(step_rank) as a, max(step_rank) as z from ref group by 1 union all select path_id, min(step_rank), max(step_rank) from cl group by path_id, c)"


def _haplotype_runs(v: Views, gap: int | None) -> DataFrame:
    steps = v.event_located
    first = steps.agg(F.min("path_id").alias("p")).first().p
    slices = steps.where((F.col("path_id") == first) & T.overlaps(F.col("s0"), F.col("s1"), *REGION)).select("path_id", "step_rank")
    return H.haplotype_runs(steps, slices, gap)


def _shown(v: Views, gap: int | None) -> DataFrame:
    s = S.run_steps(v.event_located, _haplotype_runs(v, gap))
    span = s.groupBy("path_id", "start_step").agg(F.min("s0").alias("a"), F.max("s1").alias("z"))
    t = S.step_text(s, ["path_id", "start_step"]).join(span, ["path_id", "start_step"])
    return t.select("path_id", F.concat(F.lit("u"), "path_id", F.lit(":"), "a", F.lit("-"), "z").alias("name"), F.col("p_steps").alias("steps"))


@query("b_loc", f"{_DEFAULT} {_SHOW}")
def haplotype_region(v):
    return _shown(v, None)


@query("b_loc", f"{_gap_runs(0)} {_SHOW}")
def haplotype_gap_0(v):
    return _shown(v, 0)


@query("b_loc", f"{_gap_runs(5)} {_SHOW}")
def haplotype_gap_n(v):
    return _shown(v, 5)


@query("b_loc", f"{_gap_runs(5)} select distinct node from runs join b_loc using (path_id) where step_rank between a and z")
def haplotype_nodes(v):
    return H.run_nodes(v.event_located, _haplotype_runs(v, 5))


@query("b_loc", f"with {_REF} select path_id, min(step_rank) as first, max(step_rank) as last, count(*) as n_anchors from an group by 1")
def anchor_bounds(v):
    steps = v.event_located
    first = steps.agg(F.min("path_id").alias("p")).first().p
    nodes = steps.where((F.col("path_id") == first) & T.overlaps(F.col("s0"), F.col("s1"), *REGION)).select("node").distinct()
    return H.anchor_bounds(steps.where(F.col("path_id") != first).join(nodes, "node", "left_semi"))


# --- traversal -------------------------------------------------------------------------------------------------------


@query("a_seg a_link", f"with n as (select node from a_seg where {PICK}) select 'S' as kind, node as a, '' as b from n union all select 'L', src || src_orient, dst || dst_orient from a_link where src in (select node from n) and dst in (select node from n)")
def induced_subgraph(v):
    n = picked(v)
    s = X.induced_segments(v.segments, n).select(F.lit("S").alias("kind"), F.col("node").alias("a"), F.lit("").alias("b"))
    links = X.induced_links(v.links, n).select(F.lit("L").alias("kind"), F.concat("src", "src_orient").alias("a"), F.concat("dst", "dst_orient").alias("b"))
    return s.unionByName(links)


@query("a_edge", "with recursive b as (select node, 0 as level from (select 'p0' as node) union select case when node = u then v else u end, level + 1 from b join a_edge on (node = u or node = v) where level < 2) select node, min(level)::integer as level from b group by 1")
def bfs_levels(v):
    return X.bfs(v.links, v.spark.createDataFrame([("p0",)], "node string"), max_depth=2, nodes=v.segments).select("node", "level")


@query()
def bfs_all(v):
    """The search without a limit; recursive SQL over the whole graph would be too slow."""
    return X.bfs(v.links, v.spark.createDataFrame([("p0",)], "node string"), nodes=v.segments).select("node", "level")


@query()
def bfs_capped(v):
    """Over the links with repeats: a repeat has its link's ordinal, so the order is the same, and nothing need be made distinct first."""
    return X.bfs(consecutive_pairs(v.steps), v.spark.createDataFrame([("p0",), ("p7",)], "node string"), max_nodes=100, nodes=v.segments)


@query("half", "select node, side, nbr, nbr_side from half")
def half_edges(v):
    return X.half_edges(v.links).drop("overlap")


@query("half", "select distinct nbr, nbr_side from half where node = 'p1' and side = 'end'")
def children(v):
    return X.children(v.links, "p1", 1).drop("overlap")


@query("half", "select side, nbr, count(*) as n from half where node = 'p1' group by all")
def neighbours(v):
    return X.neighbours(v.links, "p1").groupBy("side", "nbr").agg(F.count("*").alias("n"))


@query("half a_link", "with l as (select * from half where node <> 'p5' and nbr <> 'p5'), s as (select path_id, step_rank, node, case when is_reverse then 'start' else 'end' end as side, lead(node) over w as nbr, case when lead(is_reverse) over w then 'end' else 'start' end as nbr_side from a_step window w as (partition by path_id order by step_rank)) select path_id, step_rank from s where nbr is not null and not exists (select 1 from l where l.node = s.node and l.side = s.side and l.nbr = s.nbr and l.nbr_side = s.nbr_side)")
def path_exists(v):
    gone = v.spark.createDataFrame([("p5",)], "node string")
    return X.missing_edges(v.steps, X.remove_nodes(v.links, v.segments, gone)[1])


@query("a_step a_seg", "with q as (select path_id, step_rank, is_reverse, substr(repeat(['ACGT', 'GGAC', 'TTCA', 'NACG'][p_partkey % 4 + 1], 13), 1, length) as s from a_step join a_seg using (node)) select path_id, string_agg(case when is_reverse then translate(reverse(s), 'ACGTN', 'TGCAN') else s end, '' order by step_rank) as sequence from q group by 1")
def path_sequence(v):
    return X.path_sequences(v.steps, v.segments, reverse_complement)


@query("a_edge", "with e as (select u, v from a_edge where u <> v), b as (select u, v from e union all select v, u from e) select u as node, count(*) as n, string_agg(v, ' ' order by v) as neighbours from b group by 1")
def metis_adjacency(v):
    return V.adjacency(v.links)


@query("a_edge", "select node, count(*) as degree from (select u as node from a_edge union all select v from a_edge where u <> v) group by 1")
def degrees(v):
    return C.degrees(v.links)


@query("a_seg a_step", "with a as (select node from a_seg), b as (select distinct node from a_step where path_id % 10 = 0) select (select count(*) from a) as n1, (select count(*) from b) as n2, (select count(*) from a where node in (select node from b)) as shared")
def compare_nodes(v):
    return V.compare_nodes(v.segments, v.steps.where("path_id % 10 = 0"))


@query("a_link a_seg", f"with s as (select node from a_seg where {PICK}) select src, src_orient, dst, dst_orient from a_link where src not in (select node from s) or dst not in (select node from s)")
def orphan_links(v):
    return X.orphan_links(v.links, picked(v)).select("src", "src_orient", "dst", "dst_orient")


@query("a_seg", "select count(*) as n_nodes, sum(length)::bigint as total_length from a_seg")
def graph_totals(v):
    return v.segments.agg(F.count("*").alias("n_nodes"), F.sum("length").alias("total_length"))


# --- loci, manifests, tables of runs ---------------------------------------------------------------------------------

_LOCI = "loci as (select p_partkey as query_id, 'c' || (p_partkey % 150) as c, p_partkey * 3 as position from part)"


def _loci(v: Views) -> DataFrame:
    c = F.concat(F.lit("c"), F.col("p_partkey") % 150)
    return v.table("part").select(F.col("p_partkey").alias("query_id"), c.alias("sample"), F.lit(0).cast("long").alias("hap"), c.alias("seq_id"), (F.col("p_partkey") * 3).alias("position"))


@query("w_path", f"with {_LOCI}, h as (select query_id, path_id, position - seq_start as local from loci join w_path using (c) where position >= seq_start and position < seq_end) select query_id, count(path_id) as n, case when count(path_id) = 1 then min(path_id) end as path_id, case when count(path_id) = 1 then min(local) end as local_position from loci left join h using (query_id) group by 1")
def locus_resolution(v):
    return V.resolve_loci(_loci(v), v.walks)


_MANIFEST = "m as (select 'g' || (p_partkey % 5) as graph, 'q' || (p_partkey % 120) as query_id, case when p_partkey % 11 = 0 then '' else 's' end as sample, case when p_partkey % 3 = 0 then 1 end as node_position, case when p_partkey % 4 = 0 then 10 end as region_start, case when p_partkey % 4 = 0 and p_partkey % 8 <> 0 then 20 end as region_end from part)"


@query("a_seg", f"with {_MANIFEST} select graph, query_id, 'unknown graph' as problem from m where graph = 'g4' union all select graph, query_id, 'duplicate query' from m group by all having count(*) > 1 union all select graph, query_id, 'empty identity' from m where sample = '' union all select graph, query_id, 'neither node nor region' from m where node_position is null and region_start is null and region_end is null union all select graph, query_id, 'half a region' from m where (region_start is null) <> (region_end is null)")
def manifest_checks(v):
    k = F.col("p_partkey")
    m = v.table("part").select(
        F.concat(F.lit("g"), k % 5).alias("graph"), F.concat(F.lit("q"), k % 120).alias("query_id"), F.when(k % 11 == 0, "").otherwise("s").alias("sample"), F.lit("0").alias("haplotype"), F.lit("chr").alias("seq_id"),
        F.when(k % 3 == 0, 1).alias("node_position"), F.when(k % 4 == 0, 10).alias("region_start"), F.when((k % 4 == 0) & (k % 8 != 0), 20).alias("region_end"),
    )
    return V.manifest_problems(m, v.spark.createDataFrame([(f"g{i}",) for i in range(4)], "graph string"))


@query(text="select event_type as tool, user_id % 4 as threads, count(*) as n, round(avg(event_id % 100)::double, 9) as mean_seconds, max(event_id) as max_memory from events group by 1, 2")
def run_rollup(v):
    runs = v.table("events").select(F.col("event_type").alias("tool"), (F.col("user_id") % 4).alias("threads"), (F.col("event_id") % 100).alias("seconds"), F.col("event_id").alias("peak_kb"))
    return V.rollup_runs(runs, ["tool", "threads"]).withColumn("mean_seconds", F.round("mean_seconds", 9))


@query(text="select user_id as key, round(avg(event_id % 100) filter (event_id % 2 = 0)::double, 9) as even, round(avg(event_id % 100) filter (event_id % 2 = 1)::double, 9) as odd from events group by 1")
def pivot_runs(v):
    runs = v.table("events").select(F.col("user_id").alias("key"), F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd").alias("tool"), (F.col("event_id") % 100).alias("seconds"))
    p = V.pivot_runs(runs, ["key"], "tool", ["even", "odd"])
    return p.select("key", F.round("even", 9).alias("even"), F.round("odd", 9).alias("odd"))


@query(text="with l as (select user_id, arg_max(event_id, ts) as latest, arg_min(event_id, ts) as baseline from events group by 1) select user_id, latest, baseline, latest - baseline as delta, case when baseline <> 0 then 100.0::double * (latest - baseline) / baseline end as percent from l")
def latest_per_group(v):
    e = v.table("events")
    base = e.groupBy("user_id").agg(F.min_by("event_id", "ts").alias("baseline"))
    return V.latest(e, "user_id", "ts", "event_id", base).select("user_id", "latest", "baseline", "delta", "percent")


@query(text="select p_brand as graph, p_type as tool, 'f' || (p_partkey % 3) as file, sum(p_size)::bigint as bytes from part group by 1, 2, 3 union all select p_brand, p_type, 'TOTAL', sum(p_size)::bigint from part group by 1, 2")
def size_rollup(v):
    files = v.table("part").select(F.col("p_brand").alias("graph"), F.col("p_type").alias("tool"), F.concat(F.lit("f"), F.col("p_partkey") % 3).alias("file"), F.col("p_size").alias("bytes"))
    return V.size_table(files, ["graph", "tool", "file"])


@query("a_seg a_link", "select 'steps' as section, count(*) as rows, (count(*) * 4)::bigint as bytes from a_step union all select 'postings', count(*), (count(*) * 12)::bigint from a_step union all select 'nodes', count(*), sum(strlen(node) + 20)::bigint from a_seg union all select 'paths', count(*), sum(strlen('o' || path_id) + 40)::bigint from (select distinct path_id from a_step) union all select 'links', count(*), sum(strlen(src) + strlen(dst) + 2)::bigint from a_link")
def size_breakdown(v):
    return V.size_breakdown(v.segments, v.links, v.paths, v.steps)


@query("a_seg", "select p_partkey as query_id, node, case when p_partkey % 2 = 0 then 'x' || p_partkey end as first_name, case when p_partkey % 3 = 0 then 'y' || p_partkey end as second_name from a_seg")
def locus_audit(v):
    s = v.segments
    named = lambda k, x: s.where(f"p_partkey % {k} = 0").select("node", F.concat(F.lit(x), "p_partkey").alias("name"))
    return V.locus_audit(s.select(F.col("p_partkey").alias("query_id"), "node"), named(2, "x"), named(3, "y")).select("query_id", "node", "first_name", "second_name")
