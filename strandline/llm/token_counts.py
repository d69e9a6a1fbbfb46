"""Token counts by section, from one encoding of the whole document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import default_path, encoder

RULES = ("start", "end", "most")


def attribute(starts: np.ndarray, stops: np.ndarray, bounds: np.ndarray, rule: str = "start") -> np.ndarray:
    """Tokens of each section. Tokens cover [starts, stops), sections [bounds[i], bounds[i + 1]), all in bytes of the document.

    A token that crosses a boundary goes to the section of its first byte ("start"), of its last one ("end"), or to the one
    that holds most of its bytes, the first of those that tie ("most").
    """
    n = len(bounds) - 1
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, stops - 1, "right") - 1
    at = last.copy() if rule == "end" else first.copy()
    if rule == "most":
        for k in np.flatnonzero(first != last):
            cover = [min(stops[k], bounds[s + 1]) - max(starts[k], bounds[s]) for s in range(first[k], last[k] + 1)]
            at[k] = first[k] + int(np.argmax(cover))
    crossing = np.bincount(at[first != last], minlength=n)[:n]
    return np.stack([np.bincount(at, minlength=n)[:n], crossing])


def section_bounds(raw: bytes) -> np.ndarray:
    """Sections are the lines, each with its line break; a text has one at least."""
    b = np.frombuffer(raw, dtype=np.uint8)
    ends = np.flatnonzero(b == 10) + 1
    return np.concatenate([[0], ends if len(ends) and ends[-1] == len(b) else np.append(ends, len(b))])


def _count(path: str, rule: str):
    names = ["doc_id", "section", "start", "n_chars", "n_tokens", "n_crossing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids_at, columns = [], [[] for _ in names[1:]]
            rows = 0
            for n, t in enumerate(batch.column(1)):
                text = t.as_py() or ""
                raw = text.encode("utf-8", "surrogatepass")
                stops = np.cumsum(enc.lengths[enc.ids(text)])
                starts = np.concatenate([[0], stops[:-1]]) if len(stops) else stops
                bounds = section_bounds(raw)
                chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)])[bounds]
                got, crossing = attribute(starts, stops, bounds, rule)
                size = len(bounds) - 1
                ids_at.append(np.full(size, n))
                for column, v in zip(columns, (np.arange(size), chars[:-1], np.diff(chars), got, crossing), strict=True):
                    column.append(v.astype(np.int64))
                rows += size
                if rows > 50_000 or n == len(batch) - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(ids_at))), *(pa.array(np.concatenate(c)) for c in columns)], names)
                    ids_at, columns, rows = [], [[] for _ in names[1:]], 0

    return run


def token_counts(docs: DataFrame, path: str | None = None, rule: str = "start") -> DataFrame:
    """(doc_id, section, start, n_chars, n_tokens, n_crossing): one row per line of docs(doc_id, text).

    The whole document is encoded once; tokens are joined to lines by their byte spans; n_crossing counts those of the line's
    tokens that reach into another line, allocated by `rule` (see `attribute`). start and n_chars count code points. Null and
    empty texts are one empty section; repeated rows are counted each; an empty table gives no rows; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(_count(path or default_path(), rule), "doc_id long, section long, start long, n_chars long, n_tokens long, n_crossing long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
