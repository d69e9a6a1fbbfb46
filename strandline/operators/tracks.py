"""Coordinate tracks: building, listing, region queries over tracks and straight from paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import name_base, name_end, name_start
from ..sources.gfa import Graph, reference_samples
from .prefix import located

KEY = ["reference", "sequence", "haplotype"]


def overlaps(start: Column, end: Column, begin: int | Column, stop: int | Column) -> Column:
    """Half-open intervals that share a base."""
    return (start < stop) & (end > begin)


def placed_paths(paths: DataFrame) -> DataFrame:
    """Paths with a place on a sequence: reference, sequence, haplotype, seq_start, seq_end, source_type. Walks need both coordinates; P names may carry them, else they start at 0 and end where their steps do (null here)."""
    p = paths.withColumn("_s", name_start(F.col("name"))).withColumn("_e", name_end(F.col("name")))
    is_p = F.col("record_type") == "P"
    return p.where(is_p | (F.col("seq_start").isNotNull() & F.col("seq_end").isNotNull())).select(
        "path_id", F.col("record_type").alias("source_type"), "name", "overlaps",
        F.when(is_p, F.lit("")).otherwise(F.col("sample")).alias("reference"), F.when(is_p, name_base(F.col("name"))).otherwise(F.col("seq_id")).alias("sequence"),
        F.when(is_p, F.lit(0)).otherwise(F.col("hap")).cast("long").alias("haplotype"),
        F.when(is_p, F.coalesce("_s", F.lit(0))).otherwise(F.col("seq_start")).cast("long").alias("seq_start"), F.when(is_p, F.col("_e")).otherwise(F.col("seq_end")).cast("long").alias("seq_end"),
    )


def path_entries(located_steps: DataFrame, placed: DataFrame) -> DataFrame:
    """(path_id, step, start, end, node) in sequence coordinates."""
    d = located_steps.join(placed.select("path_id", "seq_start"), "path_id")
    return d.select("path_id", F.col("step_rank").alias("step"), (F.col("seq_start") + F.col("s0")).alias("start"), (F.col("seq_start") + F.col("s1")).alias("end"), "node")


def ends_from_starts(entries: DataFrame, tracks: DataFrame) -> DataFrame:
    """entries(track_id, step, start, node) with the end each next start, the last one's that of its track."""
    nxt = F.lead("start").over(Window.partitionBy("track_id").orderBy("step"))
    return entries.withColumn("_n", nxt).join(tracks.select("track_id", "seq_end"), "track_id").select("track_id", "step", "start", F.coalesce("_n", "seq_end").alias("end"), "node")


def check_spans(entries: DataFrame, placed: DataFrame) -> DataFrame:
    """Placed paths whose declared end isn't where their steps end."""
    got = entries.groupBy("path_id").agg(F.max("end").alias("actual_end"))
    return placed.join(got, "path_id").where("seq_end is not null and seq_end <> actual_end").select("path_id", "name", "seq_end", "actual_end")


def overlapping_tracks(tracks: DataFrame) -> DataFrame:
    """Tracks that start before an earlier one of their reference, sequence and haplotype ends."""
    w = Window.partitionBy(*KEY).orderBy("seq_start", "seq_end")
    return tracks.withColumn("previous_end", F.max("seq_end").over(w.rowsBetween(Window.unboundedPreceding, -1))).where("seq_start < previous_end")


def rgfa_fragments(segments: DataFrame) -> DataFrame:
    """(sequence, fragment, start, end, node) of segments of rank 0: by start, a new fragment after each hole; overlaps are an error."""
    w = Window.partitionBy("sn").orderBy("so", "node")
    s = segments.where("sr = 0 and sn is not null and so is not null").withColumn("_end", F.col("so") + F.col("length")).withColumn("_before", F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    bad = F.when(F.col("so") < F.col("_before"), F.raise_error(F.concat(F.lit("overlapping reference segments on "), F.col("sn"))).cast("long")).otherwise(F.when(F.col("so") > F.col("_before"), 1).otherwise(0))
    return s.withColumn("_new", bad).withColumn("fragment", F.sum("_new").over(w).cast("long")).select(F.col("sn").alias("sequence"), "fragment", F.col("so").alias("start"), F.col("_end").alias("end"), "node")


def rgfa_tracks(fragments: DataFrame) -> DataFrame:
    return fragments.groupBy("sequence", "fragment").agg(F.min("start").alias("seq_start"), F.max("end").alias("seq_end"), F.count("*").alias("entry_count"))


def _raise_if(df: DataFrame, message: str) -> None:
    row = df.limit(1).collect()
    if row:
        raise ValueError(f"{message}: {row[0].asDict()}")


def build_tracks(graph: Graph, reference: str | None = None, selection: DataFrame | None = None, steps: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(tracks, entries). Sources, in this order: the selected paths; the walks of `reference` or of every sample that the header's
    RS tag names; the segments of rank 0, if no reference was asked for. None of them is an error, as are spans that disagree
    with the steps, overlapping tracks and selected paths with overlaps between steps."""
    if reference is not None and selection is not None:
        raise ValueError("give a reference or a selection, not both")
    steps = located(graph.steps, graph.segments) if steps is None else steps
    chosen = None
    if selection is not None:
        _raise_if(selection.where("record_type = 'P' and coalesce(overlaps, '*') not in ('*', '')"), "a path with overlaps has no coordinates")
        chosen = selection
    else:
        walks = graph.paths.where("record_type = 'W'")
        named = graph.paths.sparkSession.createDataFrame([(reference,)], "sample string") if reference is not None else reference_samples(graph.headers) if graph.headers is not None else None
        if named is not None:
            chosen = walks.join(named, "sample", "left_semi")
            if chosen.isEmpty():
                chosen = None
    if chosen is not None:
        placed = placed_paths(chosen)
        entries = path_entries(steps, placed)
        _raise_if(check_spans(entries, placed), "inconsistent with segment lengths")
        spans = entries.groupBy("path_id").agg(F.max("end").alias("_end"), F.count("*").alias("entry_count"))
        tracks = placed.join(spans, "path_id").select(F.col("path_id").alias("track_id"), "source_type", "name", *KEY, "seq_start", F.col("_end").alias("seq_end"), "entry_count")
        entries = entries.withColumnRenamed("path_id", "track_id")
    else:
        if reference is not None:
            raise ValueError(f"no walk of reference {reference!r}")
        f = rgfa_fragments(graph.segments)
        if f.isEmpty():
            raise ValueError("no source of coordinates: no selection, no reference walks, no segments of rank 0")
        tracks = rgfa_tracks(f).withColumn("track_id", F.dense_rank().over(Window.orderBy("sequence", "fragment")).cast("long") - 1)
        step = F.row_number().over(Window.partitionBy("sequence", "fragment").orderBy("start")) - 1
        entries = f.withColumn("step", step.cast("long")).join(tracks.select("track_id", "sequence", "fragment"), ["sequence", "fragment"]).select("track_id", "step", "start", "end", "node")
        tracks = tracks.select("track_id", F.lit("S").alias("source_type"), F.col("sequence").alias("name"), F.lit("").alias("reference"), "sequence", F.lit(0).cast("long").alias("haplotype"), "seq_start", "seq_end", "entry_count")
    _raise_if(overlapping_tracks(tracks), "overlapping coordinate tracks")
    return tracks, entries


def region_entries(tracks: DataFrame, entries: DataFrame, sequence: str, begin: int, end: int, reference: str | None = None) -> DataFrame:
    """Entries of the sequence that overlap [begin, end). Without a reference the sequence must occur in one only, wherever; all haplotypes count."""
    t = tracks.where(F.col("sequence") == sequence)
    if reference is None:
        names = [r.reference for r in t.select("reference").distinct().limit(2).collect()]
        if len(names) > 1:
            raise ValueError(f"sequence {sequence!r} is in several references; name one")
    else:
        t = t.where(F.col("reference") == reference)
    t = t.where(overlaps(F.col("seq_start"), F.col("seq_end"), begin, end))
    e = entries.where(overlaps(F.col("start"), F.col("end"), begin, end))
    return e.join(t.select("track_id", "source_type"), "track_id")


def region_on_the_fly(paths: DataFrame, located_steps: DataFrame, sequence: str, begin: int, end: int, reference: str | None = None) -> DataFrame:
    """(path_id, step, start, end, node) of the region, straight from path metadata and steps.

    P paths match by their whole name or by the name without coordinates, walks by sequence. With a reference its walks count,
    else P paths first, then the walks, which must be of one sample among those that overlap. A P path with overlaps, a span
    that disagrees with the steps, and overlapping fragments are errors.
    """
    placed = placed_paths(paths).where(F.col("seq_end").isNull() | overlaps(F.col("seq_start"), F.col("seq_end"), begin, end))
    p = placed.where("source_type = 'P'").where((F.col("name") == sequence) | (F.col("sequence") == sequence))
    w = placed.where("source_type = 'W'").where(F.col("sequence") == sequence)
    if reference is not None:
        found = w.where(F.col("reference") == reference)
        if found.isEmpty():
            found = p.where((F.lit(reference) == F.col("sequence")) | (F.lit(reference) == ""))
    else:
        found = p if not p.isEmpty() else w
        if len(found.select("reference").distinct().limit(2).collect()) > 1:
            raise ValueError(f"several references overlap {sequence}:{begin}-{end}; name one")
    if found.isEmpty():
        raise ValueError(f"no path covers {sequence}:{begin}-{end}")
    _raise_if(found.where("source_type = 'P' and coalesce(overlaps, '*') not in ('*', '')").select("name"), "a path with overlaps has no coordinates")
    whole = path_entries(located_steps.join(found.select("path_id"), "path_id", "left_semi"), found)
    _raise_if(check_spans(whole, found), "inconsistent with segment lengths")
    spans = whole.groupBy("path_id").agg(F.min("start").alias("seq_start"), F.max("end").alias("seq_end"))
    tracks = found.drop("seq_start", "seq_end").join(spans, "path_id").where(overlaps(F.col("seq_start"), F.col("seq_end"), begin, end))
    w2 = Window.orderBy("seq_start", "seq_end")
    _raise_if(tracks.withColumn("_b", F.max("seq_end").over(w2.rowsBetween(Window.unboundedPreceding, -1))).where("seq_start < _b").select("name"), "overlapping path fragments")
    return whole.where(overlaps(F.col("start"), F.col("end"), begin, end))


def region(graph: Graph, sequence: str, begin: int, end: int, reference: str | None = None, tracks: DataFrame | None = None, entries: DataFrame | None = None, steps: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """(slices(path_id, step_rank, node), warnings): by tracks where there are some, else, or if they fail, on the fly. path_id is null for segment tracks."""
    warnings: list[str] = []
    steps = located(graph.steps, graph.segments) if steps is None else steps
    if tracks is not None:
        try:
            found = region_entries(tracks, entries, sequence, begin, end, reference)
            if not found.isEmpty():
                return found.select(F.when(F.col("source_type") != "S", F.col("track_id")).alias("path_id"), F.col("step").alias("step_rank"), "node"), warnings
            warnings.append("no track covers the region")
        except ValueError as error:
            warnings.append(str(error))
    try:
        found = region_on_the_fly(graph.paths, steps, sequence, begin, end, reference)
    except ValueError as error:
        raise ValueError("; ".join([*warnings, str(error)])) from None
    return found.select("path_id", F.col("step").alias("step_rank"), "node"), warnings


def list_coordinates(paths: DataFrame, tracks: DataFrame | None, step_counts: DataFrame | None = None) -> DataFrame:
    """source, reference, haplotype, sequence, start, end, entries, coordinate_access of every path and track.

    cdx: a track of the same name, span and number of steps; stale_cdx: a track that no longer agrees with its path;
    on_the_fly: no track, but coordinates can be derived; unavailable: neither.
    """
    p = paths.withColumn("_s", name_start(F.col("name"))).withColumn("_e", name_end(F.col("name")))
    if step_counts is not None:
        p = p.join(step_counts.select("path_id", "step_count"), "path_id", "left")
    else:
        p = p.withColumn("step_count", F.lit(None).cast("long"))
    is_p = F.col("record_type") == "P"
    able = F.when(is_p, F.coalesce(F.col("overlaps"), F.lit("*")).isin("*", "")).otherwise(F.col("seq_start").isNotNull() & F.col("seq_end").isNotNull())
    left = p.select(
        "path_id", F.col("record_type").alias("source"), F.when(is_p, F.lit("")).otherwise(F.col("sample")).alias("reference"), F.when(is_p, F.lit(0)).otherwise(F.col("hap")).cast("long").alias("haplotype"),
        F.when(is_p, name_base(F.col("name"))).otherwise(F.col("seq_id")).alias("sequence"), F.when(is_p, F.coalesce("_s", F.lit(0))).otherwise(F.col("seq_start")).cast("long").alias("start"),
        F.when(is_p, F.col("_e")).otherwise(F.col("seq_end")).cast("long").alias("end"), F.col("step_count").alias("entries"), able.alias("_able"),
    )
    star = lambda c: F.coalesce(c.cast("string"), F.lit("*"))
    if tracks is None:
        access = F.when(F.col("_able"), "on_the_fly").otherwise("unavailable")
        return left.select("source", "reference", "haplotype", "sequence", star(F.col("start")).alias("start"), star(F.col("end")).alias("end"), "entries", access.alias("coordinate_access"))
    t = tracks.select(F.when(F.col("source_type") != "S", F.col("track_id")).alias("path_id"), F.col("source_type").alias("t_source"), F.col("reference").alias("t_reference"), F.col("haplotype").alias("t_haplotype"), F.col("sequence").alias("t_sequence"), F.col("seq_start").alias("t_start"), F.col("seq_end").alias("t_end"), F.col("entry_count").alias("t_entries"))
    j = left.join(t, "path_id", "full_outer")
    agrees = (F.col("start") == F.col("t_start")) & (F.col("end").isNull() | (F.col("end") == F.col("t_end"))) & (F.col("entries").isNull() | (F.col("entries") == F.col("t_entries")))
    access = F.when(F.col("source").isNull(), F.when(F.col("t_source") == "S", "cdx").otherwise("stale_cdx")).when(F.col("t_source").isNotNull() & agrees, "cdx").when(F.col("t_source").isNotNull(), "stale_cdx").when(F.col("_able"), "on_the_fly").otherwise("unavailable")
    either = lambda a, b: F.coalesce(F.col(a), F.col(b))
    return j.select(
        either("source", "t_source").alias("source"), either("reference", "t_reference").alias("reference"), either("haplotype", "t_haplotype").alias("haplotype"), either("sequence", "t_sequence").alias("sequence"),
        star(either("t_start", "start")).alias("start"), star(either("t_end", "end")).alias("end"), either("t_entries", "entries").alias("entries"), access.alias("coordinate_access"),
    )
