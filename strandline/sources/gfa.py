"""Reading graph text: records, segments, links, paths, walks, steps and the small list files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tag_map, tag_value, walk_name
from ..plans.lineage import cut

MAX_LENGTH = 4294967295


def read_records(spark: SparkSession, path: str | list[str], strip_cr: bool = False) -> DataFrame:
    """(ordinal, value): the non-empty lines of plain or gzip text in file order. Concatenated gzip members are read through."""
    df = spark.read.text(path)
    value = F.regexp_replace("value", "\r$", "") if strip_cr else F.col("value")
    return df.select(F.monotonically_increasing_id().alias("ordinal"), value.alias("value")).where("value <> ''")


def records_of(spark: SparkSession, lines: list[str]) -> DataFrame:
    """Records of lines at hand."""
    return spark.createDataFrame([(i, x) for i, x in enumerate(lines) if x], "ordinal long, value string")


#: Lines that one window partition numbers at most, as a power of two.
NUMBERED = 14


def dense_index(df: DataFrame, order: str, name: str) -> DataFrame:
    """Adds 0, 1, 2 ... in the order of a unique long column that monotonically_increasing_id() made or that counts lines.

    Lines are counted by stretches of 2**NUMBERED numbers, the counts added up, and rows numbered within stretches, so no task sees all
    rows and the sum over stretches is short."""
    part = F.shiftright(F.col(order), NUMBERED).alias("_part")
    n = df.groupBy(part).count()
    base = n.select(F.col("_part"), F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    d = df.withColumn("_part", F.shiftright(F.col(order), NUMBERED))
    d = d.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1).join(F.broadcast(base), "_part")
    return d.withColumn(name, (F.col("_base") + F.col("_row")).cast("long")).drop("_part", "_row", "_base")


def of_type(records: DataFrame, kind: str) -> DataFrame:
    """Records of a type with their tab-separated fields."""
    return records.where(F.col("value").startswith(f"{kind}\t") | (F.col("value") == kind)).withColumn("f", F.split("value", "\t"))


def _bad(condition: Column, value: Column) -> Column:
    return F.when(condition, F.raise_error(F.concat(F.lit("Offending line: "), F.substring("value", 1, 200))).cast("string")).otherwise(value)


def _tags(first: int) -> Column:
    """Optional fields, from the first-th (counted from 0)."""
    return F.slice("f", first + 1, F.greatest(F.size("f") - first, F.lit(0)))


def parse_segments(records: DataFrame) -> DataFrame:
    """S records. length is that of the sequence, else the LN tag; neither is an error, as is one over 32 bits."""
    s = of_type(records, "S").withColumn("t", _tags(3))
    node = _bad((F.size("f") < 3) | (F.get("f", F.lit(1)) == "") | (F.get("f", F.lit(2)) == ""), F.get("f", F.lit(1)))
    seq = F.get("f", F.lit(2))
    length = F.when(seq != "*", F.length(seq).cast("long")).otherwise(tag_value(F.col("t"), "LN").cast("long"))
    fine = F.when(length.isNull() | (length > MAX_LENGTH), F.raise_error(F.concat(F.lit("segment without a usable length: "), node)).cast("long")).otherwise(length)
    number = lambda k: tag_value(F.col("t"), k).cast("long").alias(k.lower())
    return s.select(node.alias("node"), seq.alias("seq"), fine.alias("length"), tag_map(F.col("t")).alias("tags"), tag_value(F.col("t"), "SN").alias("sn"), number("SO"), number("SR"), "ordinal", F.col("value").alias("raw"))


def parse_links(records: DataFrame) -> DataFrame:
    """L records with both orientations."""
    g = lambda k: F.get("f", F.lit(k))
    bad = (F.size("f") < 5) | ~g(2).isin("+", "-") | ~g(4).isin("+", "-") | (g(1) == "") | (g(3) == "")
    return of_type(records, "L").select(_bad(bad, g(1)).alias("src"), g(2).alias("src_orient"), g(3).alias("dst"), g(4).alias("dst_orient"), F.coalesce(g(5), F.lit("*")).alias("overlap"), "ordinal", F.col("value").alias("raw"))


def _coordinate(c: Column) -> Column:
    return F.when(c != "*", c.cast("long"))


def parse_path_lines(records: DataFrame) -> DataFrame:
    """P and W records as paths plus their step text; path_id is the order in the file."""
    g = lambda k: F.get("f", F.lit(k))
    p = of_type(records, "P").select(
        "ordinal", "value", F.lit("P").alias("record_type"), _bad((F.size("f") < 3) | (g(1) == "") | (g(2) == ""), g(1)).alias("name"), g(2).alias("steps_text"), F.coalesce(g(3), F.lit("*")).alias("overlaps"), _tags(4).alias("tags"),
        F.lit(None).cast("string").alias("sample"), F.lit(None).cast("long").alias("hap"), F.lit(None).cast("string").alias("seq_id"), F.lit(None).cast("long").alias("seq_start"), F.lit(None).cast("long").alias("seq_end"),
    )
    w = of_type(records, "W")
    bad = (F.size("f") < 7) | ~g(6).rlike("^([><][^><]+)+$")
    w = w.select(
        "ordinal", "value", F.lit("W").alias("record_type"), _bad(bad, walk_name(g(1), g(2), g(3), _coordinate(g(4)), _coordinate(g(5)))).alias("name"), g(6).alias("steps_text"), F.lit("*").alias("overlaps"), _tags(7).alias("tags"),
        g(1).alias("sample"), g(2).cast("long").alias("hap"), g(3).alias("seq_id"), _coordinate(g(4)).alias("seq_start"), _coordinate(g(5)).alias("seq_end"),
    )
    return dense_index(p.unionByName(w), "ordinal", "path_id")


PATH_COLUMNS = ["path_id", "record_type", "name", "overlaps", "tags", "sample", "hap", "seq_id", "seq_start", "seq_end"]


def parse_paths(lines: DataFrame) -> DataFrame:
    return lines.select(*PATH_COLUMNS)


def parse_steps(lines: DataFrame) -> DataFrame:
    """One row a step, straight from the text: whole paths are never gathered."""
    p = lines.where("record_type = 'P'").select("path_id", F.posexplode(F.split("steps_text", "[,;]")).alias("step_rank", "t"))
    bad = (F.length("t") < 2) | ~F.substring("t", -1, 1).isin("+", "-")
    node = F.when(bad, F.raise_error(F.concat(F.lit("bad path step: "), F.col("t"))).cast("string")).otherwise(F.expr("substring(t, 1, length(t) - 1)"))
    p = p.select("path_id", F.col("step_rank").cast("long").alias("step_rank"), node.alias("node"), (F.substring("t", -1, 1) == "-").alias("is_reverse"))
    w = lines.where("record_type = 'W'").select("path_id", F.posexplode(F.regexp_extract_all("steps_text", F.lit("([><])([^><]+)"), F.lit(0))).alias("step_rank", "t"))
    return p.unionByName(w.select("path_id", F.col("step_rank").cast("long").alias("step_rank"), F.expr("substring(t, 2)").alias("node"), F.col("t").startswith("<").alias("is_reverse")))


def parse_headers(records: DataFrame) -> DataFrame:
    h = of_type(records, "H")
    return h.select("ordinal", F.col("value").alias("raw"), _tags(1).alias("tags"))


def reference_samples(headers: DataFrame) -> DataFrame:
    """Distinct samples that RS:Z tags name, in order."""
    return headers.select(F.explode(F.split(tag_value(F.col("tags"), "RS"), " +")).alias("sample")).where("sample <> ''").distinct().orderBy("sample")


@dataclass
class Graph:
    """The tables of one graph."""

    segments: DataFrame
    links: DataFrame
    paths: DataFrame
    steps: DataFrame
    headers: DataFrame | None = None
    communities: DataFrame | None = None


def parse(records: DataFrame) -> Graph:
    """Parse once: the tables are written to the session's checkpoint folder, so that later plans start from columns and not from text."""
    lines = cut(parse_path_lines(records))
    return Graph(cut(parse_segments(records)), cut(parse_links(records)), parse_paths(lines), cut(parse_steps(lines)), parse_headers(records))


def read_graph(spark: SparkSession, path: str | list[str]) -> Graph:
    return parse(read_records(spark, path))


def node_list(spark: SparkSession, names: str | None = None, path: str | None = None, segments: DataFrame | None = None) -> DataFrame:
    """Distinct node names of exactly one of: a comma-separated string, a file of such lines, a table of segments."""
    if sum(x is not None for x in (names, path, segments)) != 1:
        raise ValueError("give one source of node names")
    if names is not None:
        df = spark.createDataFrame([(names,)], "value string")
    elif path is not None:
        df = spark.read.text(path)
    else:
        return segments.select("node").distinct()
    return df.select(F.explode(F.split("value", ",")).alias("node")).select(F.trim("node").alias("node")).where("node <> ''").distinct()


def path_selection(records: DataFrame, paths: DataFrame) -> DataFrame:
    """Paths that a selection file names: P<tab>name or W<tab>sample<tab>hap<tab>seq<tab>start<tab>end; blank lines and # lines are skipped.

    Wrong numbers of fields, walks without coordinates, unknown paths and an empty selection are errors. Of paths of one name the first counts.
    """
    s = records.select(F.split(F.regexp_replace("value", "\r$", ""), "\t").alias("f"), "value").where("trim(value) <> '' and not value like '#%'")
    g = lambda k: F.get("f", F.lit(k))
    fine = ((g(0) == "P") & (F.size("f") == 2)) | ((g(0) == "W") & (F.size("f") == 6) & (g(4) != "*") & (g(5) != "*"))
    name = F.when(g(0) == "P", g(1)).otherwise(F.concat_ws("|", g(1), g(2), g(3), g(4), g(5)))
    s = s.select(g(0).alias("record_type"), name.alias("name"), F.coalesce(fine, F.lit(False)).alias("fine"), "value").distinct()
    known = paths.groupBy("record_type", "name").agg(F.min("path_id").alias("path_id"))
    s = s.join(known, ["record_type", "name"], "left")
    state = s.agg(F.count("*").alias("n"), F.min(F.when(~F.col("fine"), F.col("value"))).alias("bad"), F.min(F.when(F.col("fine") & F.col("path_id").isNull(), F.col("name"))).alias("unknown")).first()
    if state.bad is not None:
        raise ValueError(f"malformed selection line: {state.bad!r}")
    if state.unknown is not None:
        raise ValueError(f"unknown path in the selection: {state.unknown!r}")
    if not state.n:
        raise ValueError("the selection names no path")
    return paths.join(s.select("path_id"), "path_id", "left_semi")
