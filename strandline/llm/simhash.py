"""SimHash near-duplicates: pigeonhole buckets, pivot distance tables, verification."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, table

#: 64 bits in five blocks. Two fingerprints at 3 or fewer differing bits agree in at least two of the blocks.
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
TABLES = list(combinations(range(5), 2))
PIVOTS = 24
TILE = 2048


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Fixed pseudorandom reference fingerprints."""
    return np.random.default_rng(20240601).integers(0, 2**64, n, dtype=np.uint64)


def fingerprint(text: str | None, size: int = 3) -> int:
    """The fingerprint of one text; see `fingerprints`."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(g, 42) for g in grams), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), size) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64()), b.column(2)], ["doc_id", "fp", "text_key"])

    return run


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp, text_key): SimHash of the whole text over shingles of `size` words, repeats included.

    ASCII letters are lower-cased; words are [^\\x20\\x09-\\x0D]+; a text with fewer words is one shingle; a text without words
    (empty or null) has fingerprint 0. A bit is 1 if set in more than half of the shingles' XXH64 (seed 42). fp is the signed view.
    text_key is a 64-bit hash by which the row can be found again (see `text_key`).
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key().alias("text_key"))
    return d.mapInArrow(_fingerprint_batches(size), "doc_id long, fp long, text_key long")


def text_key() -> Column:
    return F.xxhash64(F.col("text").cast("string"), F.col("text").isNull())


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def linked_pairs(a: np.ndarray, da: np.ndarray, b: np.ndarray, db: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i into a, j into b) at most radius bits apart. a and b are sorted by their distance to the first pivot:
    only runs within radius of it are paired, then the other pivots' coordinates discard, then the bits are compared."""
    lo = np.searchsorted(db[:, 0], da[:, 0].astype(np.int16) - radius, "left")
    hi = np.searchsorted(db[:, 0], da[:, 0].astype(np.int16) + radius, "right")
    out_i, out_j = [], []
    n = hi - lo
    start = 0
    ends = np.cumsum(n)
    while start < len(a):  # in slices of about a million pairs
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + 1_000_000, "right")))
        m = n[start:stop]
        i = np.repeat(np.arange(start, stop), m)
        j = np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[start:stop], m)
        for p in range(1, da.shape[1]):
            near = np.abs(da[i, p].astype(np.int16) - db[j, p]) <= radius
            i, j = i[near], j[near]
            if p >= 4 and len(i) < 2 * stop:
                break
        near = _popcount(a[i] ^ b[j]) <= radius
        out_i.append(i[near])
        out_j.append(j[near])
        start = stop
    return np.concatenate(out_i or [np.zeros(0, int)]), np.concatenate(out_j or [np.zeros(0, int)])


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links, so that no group sends all its pairs on."""
    up = list(range(n))
    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        r, s = x, y
        while up[r] != r:
            up[r] = up[up[r]]
            r = up[r]
        while up[s] != s:
            up[s] = up[up[s]]
            s = up[s]
        if r != s:
            up[max(r, s)] = min(r, s)
            out.append((x, y))
    return out


def _link_groups(radius: int):
    ref = pivots()

    def links(fp: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        d = _popcount(fp[:, None] ^ ref[None, :]).astype(np.uint8)
        order = np.argsort(d[:, 0], kind="stable")
        fp, d, left, right = fp[order], d[order], left[order], right[order]
        ai, bi = np.flatnonzero(left), np.flatnonzero(right)
        i, j = linked_pairs(fp[ai], d[ai], fp[bi], d[bi], radius)
        i, j = ai[i], bi[j]
        keep = i != j
        return [(int(fp[x].view(np.int64)), int(fp[y].view(np.int64))) for x, y in _forest(len(fp), i[keep], j[keep])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; a group may span batches."""
        carry = None
        u: list[int] = []
        v: list[int] = []

        def take(rows: tuple[np.ndarray, ...]) -> None:
            key, fp, t, s, r = rows
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (t[1:] != t[:-1]) | (s[1:] != s[:-1])) + 1
            edges = np.concatenate([[0], cuts, [len(key)]])
            for a, b in zip(edges[:-1][np.diff(edges) > 1], edges[1:][np.diff(edges) > 1], strict=True):
                x = fp[a:b].view(np.uint64)
                same = t[a] == s[a]
                left = np.ones(b - a, bool) if same else r[a:b] == t[a]
                right = left if same else ~left
                for p, q in links(x, left, right):
                    u.append(p)
                    v.append(q)

        for b in batches:
            rows = tuple(b.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            if carry is not None:
                rows = tuple(np.concatenate(x) for x in zip(carry, rows, strict=True))
            key, _, t, s, _ = rows
            if not len(key):
                continue
            other = np.flatnonzero((key != key[-1]) | (t != t[-1]) | (s != s[-1]))
            last = int(other[-1]) + 1 if len(other) else 0
            if last:
                take(tuple(x[:last] for x in rows))
            carry = tuple(x[last:] for x in rows)
            if len(u) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
                u.clear()
                v.clear()
        if carry is not None:
            take(carry)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def fingerprint_links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """fps(fp), distinct -> links (u, v) whose components are those of all pairs at most `radius` (3 or less) bits apart.

    Each fingerprint goes to ten buckets, one for each pair of five bit blocks (pigeonhole: a linked pair shares one). In a
    bucket the pivot distance table discards pairs by their largest coordinate difference and survivors are verified bit by
    bit. A bucket of more than TILE members is cut into hashed tiles and each pair of tiles is a group of its own, so no
    bucket meets whole in one task and no pair is lost. Only a spanning forest of a group's links is returned.
    """
    keys = []
    for k, (x, y) in enumerate(TABLES):
        (ax, nx), (ay, ny) = BLOCKS[x], BLOCKS[y]
        part = lambda at, n: F.shiftrightunsigned(F.col("fp"), at).bitwiseAND(F.lit((1 << n) - 1).cast("long"))
        keys.append(F.lit(k).cast("long") * F.lit(1 << 26) + part(ax, nx) * F.lit(1 << ny) + part(ay, ny))
    d = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    n = d.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / TILE).cast("long").alias("tiles"))
    d = d.join(n, "key").withColumn("r", F.pmod(F.xxhash64("fp"), F.col("tiles")))
    d = d.select("key", "fp", "r", F.explode(F.expr("sequence(0L, tiles - 1)")).alias("o"))
    d = d.select("key", "fp", F.least("r", "o").alias("t"), F.greatest("r", "o").alias("s"), "r")
    d = d.repartition("key", "t", "s").sortWithinPartitions("key", "t", "s", "fp")
    return d.mapInArrow(_link_groups(radius), "u long, v long")


def groups(fps: DataFrame, radius: int = 3) -> DataFrame:
    """fps(fp, low), distinct in fp -> (fp, root, low): root names the component of fp."""
    comp = cut(components(fingerprint_links(fps.select("fp"), radius)))
    return fps.join(comp, fps.fp == comp.node, "left").select("fp", F.coalesce("component", "fp").alias("root"), "low")


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """One row per row of docs: (doc_id, fingerprint, component_id).

    component_id is the smallest doc_id reachable over links of fingerprints at most `radius` bits apart. Rows with a null
    doc_id take part and get the smallest other doc_id of their component, or null. Repeated rows stay; an empty table gives
    no rows; further columns are ignored.
    """
    d = cut(fingerprints(docs, size))
    root = groups(cut(d.groupBy("fp").agg(F.min("doc_id").alias("low"))), radius)
    least = root.groupBy("root").agg(F.min("low").alias("component_id"))
    named = root.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    out = d.join(named, d.fp == named._fp)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, text_key), one row per group of near duplicates: its smallest doc_id, null last; of texts that share the id the one of least key.

    Groups are those of `near_duplicates`, but by fingerprint, so that rows of one doc_id, or of none, may be in different ones.
    """
    d = fingerprints(docs, size)
    low = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("low")
    root = groups(cut(d.groupBy("fp").agg(low)), radius)
    return root.groupBy("root").agg(F.min("low").alias("low")).select("low.doc_id", "low.text_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
