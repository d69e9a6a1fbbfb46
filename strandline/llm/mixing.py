"""Mixing sources to target weights with fixed-length token blocks (DataFrame functions only).

The words of a source's documents, laid end to end in a pseudorandom order of documents, are its stream; the stream is
packed into blocks of `block` words (the last may be shorter). The mix is a number of shards of `shard` slots each. The
slots of a shard are divided among the sources by a multinomial draw whose probabilities are the targets in blocks; the
whole parts of the expected counts are given beforehand and only the rest of the slots is drawn (a residual draw: the same
expectations, and a source's total is off by about the root of the number of drawn slots instead of that of all). A source's slots are numbered
over the shards; slot j reads block perm(j mod n) of its n blocks, where perm is a pseudorandom permutation of the
indices of its own for each pass (swap-or-not rounds, a bijection for any n), and blocks are joined by that index.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Documents of a source whose places in its stream are summed up in one task: this, or the root of their number if that is more.
RUN = 2048
#: Targets are counted in blocks by whole numbers of this part, so that no sum depends on its order.
UNIT = 1024
#: Rounds of the permutation, and the prime modulus of its round functions.
ROUNDS, PRIME = 24, 2**31 - 1
WORDS = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; null: 0."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WORDS, " "))
    return F.when(squeezed == "", 0).otherwise(F.length(squeezed) - F.length(F.translate(squeezed, " ", "")) + 1).cast("long")


def _digest(*parts: Column) -> Column:
    """MD5 in hex of the parts joined by ':'."""
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def _number(digest: Column, first: int, digits: int) -> Column:
    return F.conv(F.substring(digest, first, digits), 16, 10).cast("long")


def _name(source: str) -> Column:
    return F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source)))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), limit: float = 3.0) -> DataFrame:
    """(source, source_size) -> adds target: weights repeat over the sources by code point (null last) and share the whole size;
    a target stops at limit times its source's size and the excess is reshared by weight until none is above.

    The fixed point is found at once: sources are filled in ascending order of size/weight, so a source is capped iff its
    limit is below the level that all sources not yet capped would get. Binary collation of Spark equals code point order.
    Sources of size 0 get 0. One row a source: its number is assumed to be far below that of documents.
    """
    k = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (k % len(weights) + 1).cast("int"))
    ratio = F.col("source_size") * F.lit(limit) / F.col("_w")
    up = Window.orderBy("_ratio", F.col("source").isNull(), "source")
    df = sizes.withColumn("_w", weight).withColumn("_ratio", ratio)
    df = df.withColumn("_below", F.coalesce(F.sum(F.col("source_size") * F.lit(limit)).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    df = df.withColumn("_rest", F.sum("_w").over(up.rowsBetween(0, Window.unboundedFollowing))).withColumn("_total", F.sum("source_size").over(Window.partitionBy()))
    df = df.withColumn("_level", (F.col("_total") - F.col("_below")) / F.col("_rest"))
    level = F.max(F.when(F.col("_ratio") > F.col("_level"), F.col("_level"))).over(Window.partitionBy())
    target = F.when(F.col("_ratio") > F.coalesce(level, F.lit(float("inf"))), F.col("_w") * level).otherwise(F.col("source_size") * F.lit(limit))
    return df.select("source", "source_size", target.cast("double").alias("target"))


def shard_counts(sources: DataFrame, block: int, shard: int, seed: int, limit: float) -> DataFrame:
    """The draw: (source, shard, n_blocks, first, n): the shard takes the source's slots first ... first + n - 1.

    All shards but the last are alike, so there are two kinds of them. Slots beyond `limit` passes (rounded up) over a source stay
    empty: only a draw above a capped source's whole target reaches them. Rows: for each source the shards that surely take it, and one a drawn slot.
    """
    e = F.round(F.col("target") * F.expr(f"(source_size + {block - 1}) div {block}") / F.col("source_size") * UNIT).cast("long")
    s = sources.where("source_size > 0 and target > 0").select("source", F.expr(f"(source_size + {block - 1}) div {block}").alias("n_blocks"), e.alias("_e"))
    every = Window.partitionBy()
    s = s.withColumn("_all", F.sum("_e").over(every)).withColumn("_sources", F.count("*").over(every))
    s = s.withColumn("_slots", F.expr(f"(_all + {UNIT - 1}) div {UNIT}")).withColumn("_shards", F.expr(f"(_slots + {shard - 1}) div {shard}"))
    # Kind 0: the whole shards, if there are any; kind 1: the last one.
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.lit(shard).cast("long").alias("size"), F.lit(0).cast("long").alias("low"), (F.col("_shards") - 2).alias("high")), F.struct(F.lit(1).alias("kind"), (F.col("_slots") - (F.col("_shards") - 1) * shard).alias("size"), (F.col("_shards") - 1).alias("low"), (F.col("_shards") - 1).alias("high")))
    s = s.select("*", F.explode(kinds).alias("_k")).select("source", "n_blocks", "_e", "_all", "_sources", "_k.*").where("high >= low")
    s = s.withColumn("_base", F.expr("size * _e div _all")).withColumn("_part", F.expr("size * _e % _all"))
    by = Window.partitionBy("kind").orderBy(F.col("source").isNull(), "source")
    s = s.withColumn("_to", F.sum("_part").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_span", F.sum("_part").over(Window.partitionBy("kind")))
    s = cut(s.withColumn("_from", F.col("_to") - F.col("_part")).withColumn("_cell", F.expr("_span div _sources + 1")))
    # The drawn slots of a kind's shards: a number below _span each, and the source in whose part it lies. Both meet by cells of it.
    kind = s.groupBy("kind").agg(*[F.max(c).alias(c) for c in ("low", "high", "_span", "_all", "_cell")]).where("_span > 0")
    run, parts = 1024, int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = kind.select("*", F.explode(F.sequence(F.expr(f"low div {run}"), F.expr(f"high div {run}"))).alias("_run")).repartition(parts, "kind", "_run")
    drawn = kind.select("*", F.explode(F.sequence(F.greatest("low", F.col("_run") * run), F.least("high", F.col("_run") * run + (run - 1)))).alias("shard"))
    drawn = drawn.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.expr("_span div _all"))).alias("_draw"))
    drawn = drawn.withColumn("_u", _number(_digest(F.lit("draw"), F.col("shard"), F.col("_draw"), F.lit(seed)), 1, 15) % F.col("_span"))
    drawn = drawn.select(F.col("kind").alias("_kind"), "shard", "_u", F.expr("_u div _cell").alias("_at"))
    cells = s.where("_part > 0").select("kind", "source", "n_blocks", "_from", "_to", F.explode(F.sequence(F.expr("_from div _cell"), F.expr("(_to - 1) div _cell"))).alias("_c"))
    hit = drawn.join(cells, (F.col("_kind") == F.col("kind")) & (F.col("_at") == F.col("_c")) & (F.col("_u") >= F.col("_from")) & (F.col("_u") < F.col("_to")))
    hit = hit.groupBy("source", "shard").agg(F.max("n_blocks").alias("n_blocks"), F.count("*").alias("n"))
    sure = s.where("_base > 0").select("*", F.explode(F.sequence(F.expr(f"low div {run}"), F.expr(f"high div {run}"))).alias("_run")).repartition(parts, "source", "kind", "_run")
    sure = sure.select("source", F.explode(F.sequence(F.greatest("low", F.col("_run") * run), F.least("high", F.col("_run") * run + (run - 1)))).alias("shard"), "n_blocks", F.col("_base").alias("n"))
    n = sure.unionByName(hit).groupBy("source", "shard").agg(F.max("n_blocks").alias("n_blocks"), F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = n.withColumn("first", before.cast("long"))
    return n.withColumn("n", F.least("n", F.col("n_blocks") * ceil(limit) - F.col("first"))).where("n > 0").select("source", "shard", "n_blocks", "first", "n")


def plan_slots(sources: DataFrame, block: int, seed: int, shard: int, limit: float = 3.0) -> DataFrame:
    """Slots of the mix: (source, shard, slot, epoch, index): slot `slot` of the source, in `shard`, reads block `index` on pass `epoch`."""
    df = shard_counts(sources, block, shard, seed, limit)
    df = df.select("*", F.explode(F.sequence(F.expr("first div n_blocks"), F.expr("(first + n - 1) div n_blocks"))).alias("epoch"))
    # A shard's slots of a source are unrolled where its row is dealt to; the number of parts is given, as the rows' few bytes would have Spark put them all in one.
    df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source", "shard", "epoch")
    digest = lambda r: _digest(_name("source"), F.col("epoch"), r, F.lit(seed))
    keys = F.transform(F.sequence(F.lit(1), F.lit(ROUNDS)), digest)
    keys = F.transform(keys, lambda h: F.struct((_number(h, 1, 15) % F.col("n_blocks")).alias("k"), (_number(h, 16, 8) % PRIME).alias("a"), (_number(h, 24, 8) % PRIME).alias("b")))
    df = df.withColumn("_keys", keys)
    last = F.least(F.col("first") + F.col("n"), (F.col("epoch") + 1) * F.col("n_blocks")) - 1
    df = df.select("source", "shard", "epoch", "n_blocks", "_keys", F.explode(F.sequence(F.greatest("first", F.col("epoch") * F.col("n_blocks")), last)).alias("slot"))
    n = F.col("n_blocks")

    def swap(x: Column, key: Column) -> Column:
        """x or its partner k - x, as a bit of the greater of them says: each pair is swapped or not as a whole."""
        other = F.pmod(key["k"] - x, n)
        return F.when((F.greatest(x, other) % PRIME * key["a"] + key["b"]) % PRIME % 2 == 1, other).otherwise(x)

    index = F.aggregate("_keys", F.col("slot") - F.col("epoch") * n, swap)
    return df.select("source", "shard", "slot", "epoch", index.alias("index"))


def _laid_out(docs: DataFrame, weights: tuple[float, ...], limit: float) -> tuple[DataFrame, DataFrame]:
    """Documents with their place in their source's stream, (doc_id, source, size, source_size, _at), and (source, source_size, target).

    A source's documents come by 48 bits of a digest of their ids, then by id and size. Runs of that order are summed up by windows of their own and the runs' sums by a second one.
    """
    key = _number(_digest(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 12)
    d = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")).withColumn("_h", key))
    n = d.groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("_n"))
    d = d.join(n, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_b", F.expr(f"_h div ({1 << 48}L div cast(ceil(_n / greatest({RUN}, sqrt(_n))) as bigint) + 1)")).drop("_s", "_n")
    sums = d.groupBy("source", "_b").agg(F.sum("size").alias("_s"))
    per = Window.partitionBy("source")
    sums = cut(sums.select(F.col("source").alias("_src"), F.col("_b").alias("_bk"), F.coalesce(F.sum("_s").over(per.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.sum("_s").over(per).alias("source_size")))
    sources = cut(source_targets(sums.groupBy(F.col("_src").alias("source")).agg(F.max("source_size").alias("source_size")), weights, limit))
    order = Window.partitionBy("source", "_b").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("size").over(order), F.lit(0)))
    d = d.join(sums, F.col("source").eqNullSafe(F.col("_src")) & (F.col("_b") == F.col("_bk")), "left").withColumn("_at", F.col("_base") + F.col("_in"))
    return cut(d.select("doc_id", "source", "size", "source_size", "_at")), sources


def _parts(d: DataFrame, slots: DataFrame, block: int) -> DataFrame:
    """slots(source, index, ...) joined by index with the parts of documents in the blocks: adds offset, doc_id, start, words, _at."""
    # A document's blocks, with the part of each that is the document's; a long document has many, so it is unrolled as rows.
    b = d.where("size > 0").select("doc_id", F.col("source").alias("_src"), "_at", "size", F.explode(F.sequence(F.expr(f"_at div {block}"), F.expr(f"(_at + size - 1) div {block}"))).alias("_ix"))
    b = b.withColumn("offset", F.greatest(F.col("_at") - F.col("_ix") * block, F.lit(0))).withColumn("_to", F.least(F.col("_at") + F.col("size") - F.col("_ix") * block, F.lit(block)))
    # The planner can't see how many slots a source's row unrolls into and would broadcast them.
    got = slots.hint("merge").join(b, F.col("source").eqNullSafe(F.col("_src")) & (F.col("index") == F.col("_ix")))
    start = F.col("index") * block + F.col("offset") - F.col("_at")
    return got.select(*slots.columns, "offset", "doc_id", start.alias("start"), (F.col("_to") - F.col("offset")).alias("words"), "_at")


def mixed_blocks(docs: DataFrame, block: int = 32, seed: int = 11, shard: int = 65_536, weights: tuple[float, ...] = (5, 2, 1), limit: float = 3.0) -> DataFrame:
    """The mix of docs(doc_id, text, source) itself: (shard, source, epoch, slot, index, offset, doc_id, start, words).

    A slot of a shard reads block `index` of its source. Each row is a part of it: from word `offset` of the block on, `words`
    words of the document, from its word `start` on. A slot's rows in order of offset are its block, without a gap.
    """
    d, sources = _laid_out(docs, weights, limit)
    return _parts(d, plan_slots(sources, block, seed, shard, limit), block).select("shard", "source", "epoch", "slot", "index", "offset", "doc_id", "start", "words")


def mix(docs: DataFrame, block: int = 32, seed: int = 11, shard: int = 65_536, weights: tuple[float, ...] = (5, 2, 1), limit: float = 3.0) -> DataFrame:
    """Per document (doc_id, size, source_size, target, taken) of a mix of docs(doc_id, text, source) to target weights.

    Null text has size 0; a null source is a source of its own; repeated rows are documents of their own, one after another
    in the stream; empty tables give no rows; other columns are ignored. Reruns agree. taken counts the words of the document
    in `mixed_blocks`, repeats counted, at most limit (rounded up to whole passes) times its size. A source's taken words
    differ from its target by the draw (at most one slot a drawn slot) and by the shorter last block.
    """
    d, sources = _laid_out(docs, weights, limit)
    times = plan_slots(sources, block, seed, shard, limit).groupBy("source", "index").agg(F.count("*").alias("times"))
    got = _parts(d, times, block).groupBy(F.col("source").alias("_src"), F.col("_at").alias("_key")).agg(F.sum(F.col("words") * F.col("times")).alias("_taken"))
    out = d.join(got, F.col("source").eqNullSafe(F.col("_src")) & (F.col("_at") == F.col("_key")) & (F.col("size") > 0), "left")
    t = sources.select(F.col("source").alias("_tsrc"), F.col("target"))
    out = out.join(t, F.col("source").eqNullSafe(F.col("_tsrc")), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"), "source")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


def blocks_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_blocks(table(spark, sf_dir, "documents"))


def _sql(blocks: bool, block: int = 32, seed: int = 11, shard: int = 65_536) -> str:
    """The same mix in SQL, with one window for the stream, one range join for the draw and one query a round of the permutation."""
    number = lambda h, first, digits: f"('0x' || substr({h}, {first}, {digits}))::bigint"
    rounds = [f"x0 as materialized (select u.*, ks, u.slot - u.epoch * u.n_blocks as x from u join keys k on u.source is not distinct from k.source and u.epoch = k.epoch)"]
    for r in range(1, ROUNDS + 1):
        other = f"((ks[{r}].k - x) % n_blocks + n_blocks) % n_blocks"
        rounds.append(f"x{r} as materialized (select * replace (case when (greatest(x, {other}) % {PRIME} * ks[{r}].a + ks[{r}].b) % {PRIME} % 2 = 1 then {other} else x end as x) from x{r - 1})")
    last = (
        "select shard, p.source, epoch, slot, p.ix as index, offset_ as offset, doc_id, p.ix * {b} + offset_ - at_ as start, to_ - offset_ as words from slots join p on slots.source is not distinct from p.source and slots.index = p.ix"
        if blocks else
        "select d.doc_id, size, d.source_size, target, coalesce(taken, 0)::bigint as taken from d left join t on d.source is not distinct from t.source"
        " left join (select p.source, at_, sum((to_ - offset_) * times) as taken from p join (select source, index, count(*) as times from slots group by all) s on s.source is not distinct from p.source and s.index = p.ix group by all) g"
        " on d.source is not distinct from g.source and d.at_ = g.at_ and d.size > 0"
    ).replace("{b}", str(block))
    return rf"""
with w as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, {number("md5(coalesce(doc_id::varchar, ''))", 1, 12)} as h from documents),
d as (select doc_id, source, size, (sum(size) over (partition by source))::bigint as source_size, coalesce(sum(size) over (partition by source order by h, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as at_ from w),
s0 as (select source, max(source_size) as source_size from d group by source),
s1 as (select *, [5.0::double, 2.0, 1.0][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int] as wt from s0),
s2 as (select *, source_size * 3.0::double / wt as ratio from s1),
s3 as (select *, coalesce(sum(source_size * 3.0::double) over (order by ratio, source is null, source rows between unbounded preceding and 1 preceding), 0.0) as below, sum(wt) over (order by ratio, source is null, source rows between current row and unbounded following) as rest, sum(source_size) over () as total from s2),
s4 as (select *, (total - below) / rest as lv from s3),
t as (select source, source_size, case when ratio > coalesce(max(case when ratio > lv then lv end) over (), 'infinity'::double) then wt * max(case when ratio > lv then lv end) over () else source_size * 3.0::double end as target from s4),
e as (select source, (source_size + {block - 1}) // {block} as n_blocks, round(target * ((source_size + {block - 1}) // {block}) / source_size * {UNIT})::bigint as e from t where source_size > 0 and target > 0),
a as (select *, (sum(e) over ())::bigint as alle, (((sum(e) over ())::bigint + {UNIT - 1}) // {UNIT})::bigint as n_slots from e),
k as (select *, (n_slots + {shard - 1}) // {shard} as shards, 0 as kind, {shard}::bigint as size from a union all select *, (n_slots + {shard - 1}) // {shard}, 1, n_slots - ((n_slots + {shard - 1}) // {shard} - 1) * {shard} from a),
c as (select *, case kind when 0 then 0 else shards - 1 end as low, case kind when 0 then shards - 2 else shards - 1 end as high, size * e // alle as base, size * e % alle as part from k),
f as (select *, (sum(part) over (partition by kind order by source is null, source rows between unbounded preceding and current row))::bigint as to_, (sum(part) over (partition by kind))::bigint as span from c where high >= low),
draws as (select kind, shard, i, {number(f"md5('draw:' || shard || ':' || i || ':{seed}')", 1, 15)} % span as u from (select distinct kind, low, high, span, alle from f where span > 0), unnest(range(low, high + 1)) as x(shard), unnest(range(1, span // alle + 1)) as y(i)),
n0 as (select source, n_blocks, shard, base as n from f, unnest(range(low, high + 1)) as x(shard) where base > 0 union all select source, n_blocks, shard, 1 from draws join f on draws.kind = f.kind and u >= to_ - part and u < to_),
n1 as (select source, n_blocks, shard, sum(n)::bigint as n from n0 group by all),
n2 as (select *, coalesce(sum(n) over (partition by source order by shard rows between unbounded preceding and 1 preceding), 0)::bigint as first_ from n1),
n3 as (select source, n_blocks, shard, first_, least(n, 3 * n_blocks - first_) as n from n2),
u as (select source, n_blocks, shard, slot, slot // n_blocks as epoch from n3, unnest(range(first_, first_ + n)) as x(slot) where n > 0),
h as (select source, epoch, n_blocks, r, md5((case when source is null then 'n' else 's' || source end) || ':' || epoch || ':' || r || ':{seed}') as m from (select distinct source, epoch, n_blocks from u), unnest(range(1, {ROUNDS + 1})) as x(r)),
keys as (select source, epoch, list({{'k': {number("m", 1, 15)} % n_blocks, 'a': {number("m", 16, 8)} % {PRIME}, 'b': {number("m", 24, 8)} % {PRIME}}} order by r) as ks from h group by source, epoch),
{", ".join(rounds)},
slots as (select source, shard, slot, epoch, x as index from x{ROUNDS}),
p as (select source, doc_id, at_, ix, greatest(at_ - ix * {block}, 0) as offset_, least(at_ + size - ix * {block}, {block}) as to_ from d, unnest(range(at_ // {block}, (at_ + size - 1) // {block} + 1)) as x(ix) where size > 0)
{last}
"""


SQL, BLOCKS_SQL = _sql(False), _sql(True)
