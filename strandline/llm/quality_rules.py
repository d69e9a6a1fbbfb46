"""Host-level quality rules (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: The rules: name -> SQL condition, over the signals, under which a document fails it.
RULES = {
    "short": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "20 * n_symbols > n_words",
    "dup_lines": "5 * n_dup_lines > n_lines",
    "word_length": "n_words > 0 and (word_chars < 3 * n_words or word_chars > 10 * n_words)",
}
#: A host fails a rule whose shrunk rate is above both this much more than all hosts' mean rate and LEAST.
EXCESS, LEAST = 2.0, 0.05
#: A document of a host that fails a rule is kept if it breaks fewer rules than this.
BROKEN = 1


def signals(docs: DataFrame, window: int = 8) -> DataFrame:
    """Base signals of each row of docs(doc_id, text, source), whole texts; null text has no words.

    Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed. Windows are compared by a 64-bit hash
    within one text. Everything is a per-row array expression of n log n cost, so no words are shuffled.
    """
    d = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("_t"))
    d = d.select("doc_id", "source", "_t", F.expr(r"filter(split(_t, '[\\x20\\x09-\\x0D]+'), x -> x <> '')").alias("_w"))
    blank = F.regexp_replace("_t", SPACE, "")
    lines = F.expr(r"filter(split(_t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')")
    d = d.select(
        "doc_id", "source", "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(blank).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    hashes = F.expr(f"case when n_words < {window} then array() else transform(sequence(1, cast(n_words as int) - {window - 1}), i -> xxhash64(slice(_w, i, {window}))) end").cast("array<bigint>")
    d = d.withColumn("n_lines", F.size("_lines").cast("long")).withColumn("n_dup_lines", (F.col("n_lines") - F.size(F.array_distinct("_lines"))).cast("long")).withColumn("_h", hashes).drop("_w", "_lines")
    d = d.withColumn("_many", F.size(F.array_distinct("_h")) < F.size("_h"))
    d = d.withColumn("_p", F.expr("case when _many then array_sort(transform(_h, (h, i) -> struct(h as h, i as i))) end")).drop("_h")
    d = d.withColumn("_s", F.expr("case when _many then array_sort(transform(filter(_p, (x, k) -> (k > 0 and x.h = _p[greatest(k - 1, 0)].h) or (k + 1 < size(_p) and x.h = _p[least(k + 1, size(_p) - 1)].h)), x -> x.i)) end")).drop("_p")
    covered = F.expr(f"case when _many then aggregate(zip_with(_s, slice(_s, 2, size(_s)), (a, b) -> least({window}, coalesce(b - a, {window}))), 0L, (n, x) -> n + x) else 0L end")
    d = d.withColumn("n_repeat_words", covered).drop("_s", "_many")
    return d.withColumn("base_failed", F.expr(f"{RULES['short']} or {RULES['repeats']}"))


def host_verdicts(counts: DataFrame, excess: float = EXCESS, least: float = LEAST) -> DataFrame:
    """counts(host, rule, n_docs, n_failed), a row for each host and rule -> adds rate, prior (the rule's mean rate) and rule_failed.

    For each rule a beta prior is fitted by moments to the hosts' observed rates (each host counts once), with strength within
    [2, 1000]; rate = (n_failed + a) / (n_docs + a + b). A host fails a rule if its shrunk rate is above `excess` times the
    prior's mean and above `least`.
    """
    p = F.col("n_failed") / F.col("n_docs")
    prior = counts.groupBy(F.col("rule").alias("_rule")).agg(F.avg(p).alias("prior"), F.coalesce(F.var_samp(p), F.lit(0.0)).alias("_v"), F.avg(1.0 / F.col("n_docs")).alias("_i"))
    spread = F.col("prior") * (1 - F.col("prior"))
    # Variance between hosts beyond that of drawing n_docs documents each.
    beyond = F.greatest(F.col("_v") - spread * F.col("_i"), F.lit(0.0))
    strength = F.when(beyond > 0, spread / beyond - 1).otherwise(F.lit(1000.0))
    prior = prior.withColumn("_k", F.least(F.greatest(strength, F.lit(2.0)), F.lit(1000.0)))
    # prior has a row for each rule.
    out = counts.join(F.broadcast(prior), F.col("rule") == F.col("_rule"))
    rate = (F.col("n_failed") + F.col("prior") * F.col("_k")) / (F.col("n_docs") + F.col("_k"))
    out = out.withColumn("rate", rate)
    return out.select("host", "rule", "n_docs", "n_failed", "prior", "rate", (F.col("rate") > F.greatest(F.col("prior") * excess, F.lit(least))).alias("rule_failed"))


def quality_rules(docs: DataFrame, host: str = "source", rules: dict[str, str] | None = None, excess: float = EXCESS, least: float = LEAST, broken: int = BROKEN) -> DataFrame:
    """Base signals plus the rules a document breaks, those its host fails, and the verdict `kept`.

    Failures of each rule are counted by host and shrunk (see `host_verdicts`). A document goes for itself (base_failed), or with its
    host: if the host fails a rule and the document breaks `broken` or more of the rules its host fails. With broken = 0 every document
    of a host that fails any rule goes. Null hosts are one host. Repeated rows count each; an empty table gives no rows; other
    columns are ignored. failed_rules and host_failed_rules are arrays of names in the order of `rules`.
    """
    rules = RULES if rules is None else rules
    s = signals(docs.withColumnRenamed(host, "source") if host != "source" else docs)
    s = cut(s.withColumn("failed_rules", F.filter(F.array(*[F.when(F.expr(c), F.lit(r)) for r, c in rules.items()]), lambda r: r.isNotNull())))
    fails = [F.count(F.when(F.array_contains("failed_rules", r), 1)).alias(f"_{k}") for k, r in enumerate(rules)]
    hosts = s.groupBy(F.col("source").alias("host")).agg(F.count("*").alias("n_docs"), *fails)
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"_{k}").alias("n_failed")) for k, r in enumerate(rules)])
    counts = hosts.select("host", "n_docs", F.explode(each).alias("_r")).select("host", "_r.rule", "n_docs", "_r.n_failed")
    v = host_verdicts(counts, excess, least)
    bad = v.groupBy("host").agg(F.collect_set(F.when(F.col("rule_failed"), F.col("rule"))).alias("_bad"))
    bad = bad.select("host", F.filter(F.array(*[F.lit(r) for r in rules]), lambda r: F.array_contains("_bad", r)).alias("host_failed_rules"))
    out = s.join(bad, F.col("source").eqNullSafe(F.col("host")), "left")
    by_host = (F.size("host_failed_rules") > 0) & (F.size(F.array_intersect("failed_rules", "host_failed_rules")) >= broken)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~by_host).alias("kept"), "failed_rules", "host_failed_rules")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("failed_rules", "host_failed_rules")


def _sql() -> str:
    cases = ", ".join(f"case when {c} then '{r}' end" for r, c in RULES.items())
    return rf"""
with w as (select doc_id, source, coalesce(text, '') t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from documents),
d as (select doc_id, source, t, ws, len(ws) n, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from w),
g as (select doc_id, i, array_to_string(ws[i : i + 7], ' ') s from d, unnest(range(1, n - 6)) as r(i) where n >= 8),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, s) c from g) where c > 1),
cov as (select doc_id, sum(least(8, coalesce(nx - i, 8))) c from (select doc_id, i, lead(i) over (partition by doc_id order by i) nx from r) group by doc_id),
b as (select d.doc_id, d.source, n::bigint n_words, length(array_to_string(ws, ''))::bigint word_chars, (length(t) - length(translate(t, '{SYMBOLS}', '')))::bigint n_symbols,
 len(ls) n_lines, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(c, 0)::bigint n_repeat_words from d left join cov using (doc_id)),
f as (select *, {RULES["short"]} or {RULES["repeats"]} base_failed, list_filter([{cases}], lambda x: x is not null) fr from b),
h as (select source, rule, count(*) nd, count(*) filter (list_contains(fr, rule)) nf from f, unnest({list(RULES)}) as x(rule) group by all),
m as (select rule, avg(nf / nd) m, coalesce(var_samp(nf / nd), 0.0) v, avg(1.0::double / nd) i from h group by rule),
k as (select rule, m, least(greatest(case when v - m * (1 - m) * i > 0 then m * (1 - m) / (v - m * (1 - m) * i) - 1 else 1000.0 end, 2.0), 1000.0) k from m),
hv as (select source, list(rule) filter ((nf + m * k) / (nd + k) > greatest(m * {EXCESS}, {LEAST})) bad from h join k using (rule) group by source)
select f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and len(list_intersect(fr, coalesce(bad, []))) < {BROKEN} kept from f join hv on f.source is not distinct from hv.source
"""


SQL = _sql()
