"""A corpus from raw documents to packed sequences, as stages that each read what the one before wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import mixing, packing, quality_model, simhash, suffix_dedup
from strandline.llm.common import stash, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, learnt from the labelled ones, doesn't reject.

    Null and empty texts have the score of no evidence and repeated rows are judged alike; with no labels that score is the base rate of
    none, one half, and all stay.
    """
    model = quality_model.fit(quality_model.training_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return quality_model.scored(docs, model, tuple(COLUMNS)).where(F.col("score") >= quality_model.THRESHOLD).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row: that of the smallest doc_id, null last; of several texts of that id one, by a hash of the text.

    Rows of one doc_id with texts of different groups stay, each for its group. Of repeated rows, which are copies, one stays (the one
    whose other columns come first). Null and empty texts are copies of each other.
    """
    first = stash(simhash.representatives(docs)).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    d = docs.select(*COLUMNS).withColumn("_text_key", simhash.text_key())
    d = d.join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left_semi")
    return d.groupBy("doc_id", "_text_key").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("_row")).select("doc_id", "_row.text", "_row.lang", "_row.source", "_row.n_chars")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the bytes of passages that occur elsewhere too; n_chars counts what is left. Null texts come out empty."""
    out = suffix_dedup.remove_repeats(docs, ("lang", "source"), decode=True)
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: the quotient of words taken and size, rounded up with a probability equal to its fraction, by a hash of the id.

    Rows of one doc_id share a quotient, those of none too. Documents without words, which no mix can take, go.
    """
    taken = mixing.mix(docs).where("taken > 0").groupBy("doc_id").agg((F.sum("taken") / F.sum("size")).alias("times"))
    chance = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    copies = taken.withColumn("copies", F.floor(F.col("times") + chance).cast("int")).where("copies > 0").select(F.col("doc_id").alias("_id"), "copies")
    out = docs.select(*COLUMNS).where(mixing.n_words(F.col("text")) > 0).join(copies, F.col("doc_id").eqNullSafe(F.col("_id")))
    return out.select(*COLUMNS, F.explode(F.sequence(F.lit(1), "copies")).alias("_copy")).select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in training sequences; a null or empty text is a piece of one token, repeated rows are packed each."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("sequences", sequences),
]

#: No SQL can train the classifier or hash the shingles; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
