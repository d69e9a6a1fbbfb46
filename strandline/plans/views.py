"""Graph views of relational tables, as DataFrames and as the same views in SQL.

A: parts are segments, orders are P paths over their lines. W: the same orders as walks, laid end to end per customer. R: the
parts of each brand as reference segments with holes. B: event types by value are segments, users are walks over their events.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.prefix import located, prefix
from ..sources.gfa import Graph
from .lineage import cut


#: Rows of keys that are sent to every task instead of dealing out the table they are looked up in.
FEW = 65_536


def _null(kind: str):
    return F.lit(None).cast(kind)


def consecutive_pairs(steps: DataFrame) -> DataFrame:
    """Oriented pairs of consecutive steps, one for each place where they stand, with an ordinal by their text."""
    w = Window.partitionBy("path_id").orderBy("step_rank")
    sign = lambda c: F.when(c, "-").otherwise("+")
    d = steps.select(F.col("node").alias("src"), sign(F.col("is_reverse")).alias("src_orient"), F.lead("node").over(w).alias("dst"), F.lead(sign(F.col("is_reverse"))).over(w).alias("dst_orient"))
    return _numbered(d.where("dst is not null"))


def _numbered(pairs: DataFrame) -> DataFrame:
    return pairs.select("src", "src_orient", "dst", "dst_orient", F.lit("0M").alias("overlap"), F.xxhash64("src", "src_orient", "dst", "dst_orient").alias("ordinal"), F.concat_ws("\t", F.lit("L"), "src", "src_orient", "dst", "dst_orient", F.lit("0M")).alias("raw"))


def consecutive_links(steps: DataFrame) -> DataFrame:
    """Distinct oriented pairs of consecutive steps, with an ordinal by their text."""
    return _numbered(consecutive_pairs(steps).select("src", "src_orient", "dst", "dst_orient").distinct())


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._given: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self._given[name] if name in self._given else self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def on_sequence(self, sequence: str) -> Views:
        """These views of one sequence's walks: its orders and their lines are picked before anything is computed of them, and written once,
        as are the walks and the located steps. Nothing is looked up again in the whole tables but segments."""
        v = Views(self.spark, self.dir)
        orders = v._given["orders"] = cut(self.table("orders").where(F.concat(F.lit("c"), "o_custkey") == sequence))
        keys = orders.select(F.col("o_orderkey").alias("l_orderkey")).distinct()
        v._given["lineitem"] = cut(self.table("lineitem").join(F.broadcast(keys) if orders.count() <= FEW else keys, "l_orderkey", "left_semi"))
        v.walks, v.located = cut(v.walks), cut(v.located)
        return v

    @cached_property
    def segments(self) -> DataFrame:
        p = self.table("part")
        node = F.concat(F.lit("p"), "p_partkey")
        seq = F.substring(F.repeat(F.element_at(F.array(*[F.lit(x) for x in ("ACGT", "GGAC", "TTCA", "NACG")]), (F.col("p_partkey") % 4 + 1).cast("int")), 13), F.lit(1), F.col("p_size"))
        return p.select(node.alias("node"), seq.alias("seq"), F.col("p_size").cast("long").alias("length"), F.col("p_partkey").alias("ordinal"), F.concat_ws("\t", F.lit("S"), node, F.lit("*"), F.concat(F.lit("LN:i:"), F.col("p_size"))).alias("raw"), "p_partkey", "p_brand")

    @cached_property
    def steps(self) -> DataFrame:
        w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        return self.table("lineitem").select(F.col("l_orderkey").alias("path_id"), (F.row_number().over(w) - 1).cast("long").alias("step_rank"), F.concat(F.lit("p"), "l_partkey").alias("node"), (F.col("l_linestatus") == "F").alias("is_reverse"))

    @cached_property
    def located(self) -> DataFrame:
        return located(self.steps, self.segments)

    @cached_property
    def links(self) -> DataFrame:
        return consecutive_links(self.steps)

    @cached_property
    def paths(self) -> DataFrame:
        name = F.concat(F.lit("o"), "path_id")
        return self.steps.select("path_id").distinct().select("path_id", F.lit("P").alias("record_type"), name.alias("name"), F.lit("*").alias("overlaps"), F.array().cast("array<string>").alias("tags"), _null("string").alias("sample"), _null("long").alias("hap"), _null("string").alias("seq_id"), _null("long").alias("seq_start"), _null("long").alias("seq_end"))

    @cached_property
    def walks(self) -> DataFrame:
        total = self.steps.join(self.segments.select("node", "length"), "node").groupBy("path_id").agg(F.sum("length").alias("total"))
        o = self.table("orders").select(F.col("o_orderkey").alias("path_id"), F.concat(F.lit("c"), "o_custkey").alias("c")).join(total, "path_id")
        end = F.sum("total").over(Window.partitionBy("c").orderBy("path_id").rowsBetween(Window.unboundedPreceding, 0))
        o = o.withColumn("seq_end", end).withColumn("seq_start", F.col("seq_end") - F.col("total"))
        name = F.concat_ws("|", "c", F.lit("0"), "c", F.col("seq_start").cast("string"), F.col("seq_end").cast("string"))
        return o.select("path_id", F.lit("W").alias("record_type"), name.alias("name"), F.lit("*").alias("overlaps"), F.array().cast("array<string>").alias("tags"), F.col("c").alias("sample"), F.lit(0).cast("long").alias("hap"), F.col("c").alias("seq_id"), "seq_start", "seq_end")

    @cached_property
    def rgfa(self) -> DataFrame:
        so = F.coalesce(F.sum("length").over(Window.partitionBy("p_brand").orderBy("p_partkey").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return self.segments.select("node", "length", F.col("p_brand").alias("sn"), so.alias("so"), F.when(F.col("p_partkey") % 7 == 0, 1).otherwise(0).cast("long").alias("sr"))

    @cached_property
    def communities(self) -> DataFrame:
        return self.segments.select("node", (F.col("p_partkey") % 16).alias("community_id"))

    @cached_property
    def graph(self) -> Graph:
        return Graph(self.segments, self.links, self.paths, self.steps, None, self.communities)

    @cached_property
    def _events(self) -> DataFrame:
        k = F.least(F.floor(F.col("value") / 25), F.lit(9)).cast("long")
        w = Window.partitionBy("user_id").orderBy("ts")
        return self.table("events").select(F.col("user_id").alias("path_id"), (F.row_number().over(w) - 1).cast("long").alias("step_rank"), F.concat_ws(":", "event_type", k.cast("string")).alias("node"), (k + 1).alias("length"), (F.col("event_id") % 2 == 1).alias("is_reverse"))

    @cached_property
    def event_steps(self) -> DataFrame:
        return self._events.drop("length")

    @cached_property
    def event_located(self) -> DataFrame:
        """Written once, as an index holds it: the haplotype queries read it five times."""
        return cut(prefix(self._events))


SQL_VIEWS = {
    "a_seg": "select 'p' || p_partkey as node, p_size::bigint as length, p_partkey, p_brand from part",
    "a_step": "select l_orderkey as path_id, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1)::bigint as step_rank, 'p' || l_partkey as node, l_linestatus = 'F' as is_reverse from lineitem",
    "a_loc": "select path_id, step_rank, node, is_reverse, length, (sum(length) over w)::bigint - length as s0, (sum(length) over w)::bigint as s1 from a_step join a_seg using (node) window w as (partition by path_id order by step_rank)",
    "a_link": "select distinct src, src_orient, dst, dst_orient from (select node as src, case when is_reverse then '-' else '+' end as src_orient, lead(node) over w as dst, lead(case when is_reverse then '-' else '+' end) over w as dst_orient from a_step window w as (partition by path_id order by step_rank)) where dst is not null",
    "a_edge": "select distinct least(src, dst) as u, greatest(src, dst) as v from a_link",
    "a_comm": "select node, p_partkey % 16 as community_id from a_seg",
    "a_total": "select path_id, sum(length)::bigint as total, count(*) as n from a_step join a_seg using (node) group by path_id",
    "w_path": "select path_id, c, seq_end - total as seq_start, seq_end, n from (select o_orderkey as path_id, 'c' || o_custkey as c, total, n, (sum(total) over (partition by o_custkey order by o_orderkey))::bigint as seq_end from orders join a_total on o_orderkey = path_id)",
    "r_seg": "select node, length, p_brand as sn, coalesce(sum(length) over (partition by p_brand order by p_partkey rows between unbounded preceding and 1 preceding), 0)::bigint as so, case when p_partkey % 7 = 0 then 1 else 0 end as sr from a_seg",
    "r_frag": "select sn as sequence, (sum(new) over (partition by sn order by so))::bigint as fragment, so as start, so + length as \"end\", node from (select *, case when so > lag(so + length) over (partition by sn order by so) then 1 else 0 end as new from r_seg where sr = 0)",
    "b_ev": "select user_id as path_id, (row_number() over (partition by user_id order by ts) - 1)::bigint as step_rank, event_type || ':' || least(floor(value / 25), 9)::bigint as node, least(floor(value / 25), 9)::bigint + 1 as length, event_id % 2 = 1 as is_reverse from events",
    "b_loc": "select *, (sum(length) over w)::bigint - length as s0, (sum(length) over w)::bigint as s1 from b_ev window w as (partition by path_id order by step_rank)",
    "half": "select src as node, case when src_orient = '+' then 'end' else 'start' end as side, dst as nbr, case when dst_orient = '+' then 'start' else 'end' end as nbr_side from a_link union all select dst, case when dst_orient = '+' then 'start' else 'end' end, src, case when src_orient = '+' then 'end' else 'start' end from a_link",
}
_NEEDS = {"a_loc": ["a_seg", "a_step"], "a_link": ["a_step"], "a_edge": ["a_step", "a_link"], "a_comm": ["a_seg"], "a_total": ["a_seg", "a_step"], "w_path": ["a_seg", "a_step", "a_total"], "r_seg": ["a_seg"], "r_frag": ["a_seg", "r_seg"], "b_loc": ["b_ev"], "half": ["a_step", "a_link"]}


def sql(views: str, text: str) -> str:
    """A query over the named views, with those they need before them."""
    order: list[str] = []
    for v in views.split():
        for n in [*_NEEDS.get(v, []), v]:
            if n not in order:
                order.append(n)
    head = ", ".join(f"{n} as ({SQL_VIEWS[n]})" for n in order)
    more = text.lstrip()
    if more.startswith("with recursive "):
        return f"with recursive {head}, {more[len('with recursive '):]}"
    if more.startswith("with "):
        return f"with {head}, {more[5:]}"
    return f"with {head} {more}"
