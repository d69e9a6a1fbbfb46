"""Compression classifier: which of two zstandard dictionaries, of good or of bad text, makes a text smaller."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

THRESHOLD = 0.3


@dataclass
class Model:
    """good and bad: dictionaries; weights: logistic calibration over (1, normalised size difference, log compressibility)."""

    good: bytes
    bad: bytes
    weights: tuple[float, float, float]
    level: int = 3
    chunk: int = 1024
    _tools: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_tools"} | {"_tools": []}

    def features(self, text: str | None) -> tuple[float, float]:
        """Over the whole text in chunks: (size with the bad dictionary - size with the good one) / their sum, and the log of the
        smaller size over the text's own, at most 0: a text that repeats itself is tiny under either dictionary. (0, 0) if there is no text."""
        import zstandard

        if not self._tools:
            for d in (self.good, self.bad):
                z = zstandard.ZstdCompressionDict(d)
                z.precompute_compress(level=self.level)
                self._tools.append(zstandard.ZstdCompressor(dict_data=z, write_content_size=False, write_dict_id=False, write_checksum=False).compress)
        raw = (text or "").encode("utf-8", "surrogatepass")
        good, bad = self._tools
        a = b = 0
        for at in range(0, len(raw), self.chunk):
            part = raw[at : at + self.chunk]
            a += len(good(part))
            b += len(bad(part))
        return ((b - a) / (a + b), min(0.0, math.log(min(a, b) / len(raw)))) if raw else (0.0, 0.0)

    def score(self, text: str | None) -> float:
        d, r = self.features(text)
        w = self.weights
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, w[0] + w[1] * d + w[2] * r))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights by damped Newton steps; the first column of x is 1."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-9] + [ridge] * (x.shape[1] - 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        g = x.T @ (p - y) + penalty @ w
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 20 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def dictionary(texts: list[str], size: int, chunk: int) -> bytes:
    """A trained dictionary, or raw content where there is too little text to train on."""
    import zstandard

    parts = [raw[at : at + chunk] for t in texts for raw in [t.encode("utf-8", "surrogatepass")] for at in range(0, len(raw), chunk)]
    try:
        return zstandard.train_dictionary(size, parts, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-size:] or b"\x00" * 8


def fit(rows: list[tuple[str, int]], size: int = 65536, chunk: int = 1024) -> Model:
    """Fit on (text, quality). Dictionaries come from two thirds of the rows, the calibration from the rest; with one class only, the base rate is the score."""
    learn = [r for i, r in enumerate(rows) if i % 3]
    rest = [r for i, r in enumerate(rows) if not i % 3]
    by = {q: [t for t, y in learn if y == q] for q in (0, 1)}
    model = Model(dictionary(by[1], size, chunk), dictionary(by[0], size, chunk), (0.0, 0.0, 0.0), chunk=chunk)
    if by[0] and by[1] and len({y for _, y in rest}) == 2:
        x = np.array([(1.0, *model.features(t)) for t, _ in rest])
        model.weights = tuple(_logistic(x, np.array([y for _, y in rest], dtype=float)).tolist())
    else:
        n1 = sum(y for _, y in rows)
        model.weights = (math.log((n1 + 1) / (len(rows) - n1 + 1)), 0.0, 0.0)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = 6000, longest: int = 8_000, piece: int = 1_000) -> list[tuple[str, int]]:
    """A bounded sample of labelled documents outside the held-out fifth: at most `rows` of them, by a hash of the id.

    Of a text of more than `longest` characters it takes as many evenly spaced pieces of `piece` characters as make `longest`. So at
    most rows * longest characters reach the driver. Of labels of one id the greatest counts, of texts of one id the least. Null texts and ids teach nothing.
    """
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    known = labels.select("doc_id", "quality").where("quality in (0, 1) and doc_id is not null").where(~held).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = known.join(docs.where("text is not null").select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64(F.col("doc_id"), F.lit(5)), "doc_id").limit(rows)
    n = longest // piece
    parts = F.expr(f"concat_ws('', transform(sequence(0, {n - 1}), i -> substring(text, cast(i * (length(text) - {piece}) div {n - 1} as int) + 1, {piece})))")
    d = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id")
    got = d.select("doc_id", F.col("quality").cast("int").alias("quality"), F.when(F.length("text") > longest, parts).otherwise(F.col("text")).alias("text"))
    got = got.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    got.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    return [(r.text, r.quality) for r in got]


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = [model.score(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(score, pa.float64()), *(b.column(k) for k in range(1, b.num_columns))], ["score", *b.schema.names[1:]])

    return run


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`score` and the columns named in keep, for each row. Null and empty texts get the score of no difference; repeated rows score alike;
    an empty table gives no rows; other columns are ignored, and those in keep may have any name but `score`."""
    d = docs.select(F.col("text").cast("string").alias("_text"), *[F.col(k).alias(f"_k{n}") for n, k in enumerate(keep)])
    more = "".join(f", _k{n} {docs.schema[k].dataType.simpleString()}" for n, k in enumerate(keep))
    out = d.mapInArrow(_scores(model), f"score double{more}")
    return out.select("score", *[F.col(f"_k{n}").alias(k) for n, k in enumerate(keep)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(training_rows(docs, table(spark, sf_dir, "labels")))
    out = scored(docs, model)
    # A null doc_id has no remainder, so it is not held out.
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
