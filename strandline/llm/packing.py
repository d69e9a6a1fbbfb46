"""Best-fit packing of token sequences by minimum bin slack over the histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table
from .tokens import default_path, encoder

#: Parts that the pieces of one length are ranked in.
BUCKETS = 256


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole if they fit, else pieces of `capacity`, the first one shorter unless it divides n."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(at, capacity) for at in range(head, n, capacity)]


def _pieces(path: str, capacity: int, end: int):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        tail = np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, t in zip(batch.column(0), batch.column(1), strict=True):
                raw = enc.ids(t.as_py()).tobytes() + tail
                for k, (at, n) in enumerate(cut_points(len(raw) // 4, capacity)):
                    for column, v in zip(out, (doc_id.as_py(), k, at, n, zlib.crc32(raw[4 * at : 4 * (at + n)])), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "piece" else pa.int64()) for n, c in zip(names, out, strict=True)], names)

    return run


def fullest(counts: np.ndarray, room: int) -> dict[int, int]:
    """A multiset of lengths, within counts, of the largest possible sum up to room: bitset subset sums, bit s of `reach` telling
    whether s can be made; longer lengths first, so that a full bin is made of few pieces and short ones are left for later."""
    reach, full = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    for length in np.flatnonzero(counts[1 : room + 1])[::-1] + 1:
        left, part = min(int(counts[length]), room // int(length)), 1
        while left:
            take = min(part, left)
            new = (reach | reach << (take * int(length))) & full
            if new != reach:
                steps.append((int(length), take, reach))
                reach = new
            left -= take
            part *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= take * length
    return used


def plan(counts: np.ndarray) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: pieces}) of bins of capacity len(counts) - 1 that use up counts[length] pieces of each length.

    Each bin starts from the longest piece left and takes the fullest feasible combination with it; the combination is
    removed as often as the counts allow, after which some length has fewer pieces left than it needs. A combination has at most
    capacity / length pieces of a length, so there are at most about capacity * ln(capacity) rows, however many the pieces.
    """
    counts = counts.astype(np.int64).copy()
    capacity = len(counts) - 1
    out = []
    while counts.any():
        longest = int(np.flatnonzero(counts)[-1])
        counts[longest] -= 1
        used = fullest(counts, capacity - longest)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(int(counts[n]) // k for n, k in used.items())
        for n, k in used.items():
            counts[n] -= times * k
        out.append((times, used))
    return out


class Slots:
    """Where the r-th piece of each length goes, from a plan: a few arrays, whose size is bounded by the capacity alone."""

    def __init__(self, bins: list[tuple[int, dict[int, int]]]):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        base = 0
        for times, used in bins:
            at = 0
            for length in sorted(used, reverse=True):
                rows.setdefault(length, []).append((times * used[length], used[length], base, at))
                at += length * used[length]
            base += times
        self.by = {n: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for n, r in rows.items()}
        self.ends = {n: np.cumsum(c[0]) for n, c in self.by.items()}

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for n in np.unique(length):
            i = np.flatnonzero(length == n)
            size, each, base, at = self.by[int(n)]
            k = np.searchsorted(self.ends[int(n)], rank[i], "right")
            r = rank[i] - (self.ends[int(n)][k] - size[k])
            sequence[i] = base[k] + r // each[k]
            offset[i] = at[k] + (r % each[k]) * n
        return sequence, offset


def _place(slots: Slots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, o = slots.of(b.column(3).to_numpy(), b.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(5)), pa.array(s), pa.array(o)], [*b.schema.names[:5], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, capacity: int = 1024, path: str | None = None, end: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): docs(doc_id, text) packed into sequences of `capacity` tokens.

    A document is its ids and the id `end`; null text is empty, so every row has a piece. Only the histogram of lengths, at
    most `capacity` numbers, goes to the driver, where the plan is made; pieces of equal length are interchangeable and are
    dealt to the plan's slots by their rank, found by two levels of counts. Repeated rows are packed each; an empty table
    gives no rows; other columns are ignored.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    p = cut(d.mapInArrow(_pieces(path or default_path(), capacity, end), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    p = p.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS)).cast("int"))
    sums = p.groupBy("length", "_b").count()
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in sums.groupBy("length").agg(F.sum("count")).collect():
        counts[length] = n
    slots = Slots(plan(counts))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("length", "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    ranked = p.withColumn("_r", F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(base, ["length", "_b"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_base") + F.col("_r")).cast("long").alias("rank"))
    return ranked.mapInArrow(_place(slots), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
