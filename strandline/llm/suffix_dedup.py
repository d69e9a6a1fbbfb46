"""Removal of every byte that a repeated 200-byte string covers, exactly and over the whole corpus.

A suffix can only repeat for 200 bytes if the key of the anchor that owns the string repeats (see `anchors`), so the
corpus is first reduced to the anchors whose key occurs twice or more; all counting is map-side combined and the join back
is one that Spark can split. The strings of one key are aligned at their anchors. Where all of them read the same, nothing
remains to be compared; the others ("open" ones) are settled by interleave refinement: shards of aligned strings start as
one interleave, each step refines its runs by one more byte to the right and to the left of the anchor, and two strings
share the SPAN bytes at offset o iff after o - BEFORE left steps and LAST - o right steps they still lie in one run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors as A
from .common import stash, table

#: Keys with more distinct strings than this are settled by counting their windows' hashes across the cluster instead of in one task.
GROUP = 1 << 12
#: A string that occurs more often than this is joined back in parts, as many as this goes into its key's count, at most SALTS.
HOT, SALTS = 1 << 10, 1 << 10
ALL = -1


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the n + 1 offsets of its texts; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), starts


def _pieces(starts: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Work for anchor_rows: runs of whole texts (first, stop, ...) of up to SEGMENT bytes, or parts of one long text with margins."""
    i, n = 0, len(starts) - 1
    while i < n:
        if starts[i + 1] - starts[i] > A.SEGMENT:
            lo, hi = int(starts[i]), int(starts[i + 1])
            for at in range(lo, hi, A.SEGMENT):
                yield i, i + 1, max(lo, at - A.MARGIN), min(hi, at + A.SEGMENT + A.MARGIN), at, min(hi, at + A.SEGMENT)
            i += 1
            continue
        j = i
        while j < n and starts[j + 1] - starts[i] <= A.SEGMENT:
            j += 1
        yield i, j, int(starts[i]), int(starts[j]), int(starts[i]), int(starts[j])
        i = j


def _anchors_of(b: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, position in the text, key, full, least, most) of all texts, a piece at a time."""
    for i, j, lo, hi, at, stop in _pieces(starts):
        s = np.concatenate([[0], starts[i + 1 : j] - lo, [hi - lo]])
        t, x, key, full, least, most = A.anchor_rows(b[lo:hi], s)
        inside = (x + lo >= at) & (x + lo < stop)
        t, x = t[inside] + i, x[inside] + lo
        yield t, x - starts[t], key[inside], full[inside], least[inside], most[inside]


def _pack(tag: np.ndarray, x: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """20 bits of the text's hash, 32 of the position, 6 and 6 of the offsets."""
    return (tag << 44) | (x << 12) | ((most - A.FIRST) << 6) | (least - A.FIRST)


def _unpack(loc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (loc >> 12) & 0xFFFFFFFF, (loc & 63) + A.FIRST, ((loc >> 6) & 63) + A.FIRST


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, tags = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        b, starts = _bytes(batch.column(2))
        for t, x, key, full, least, most in _anchors_of(b, starts):
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(full.view(np.int64)), ids.take(pa.array(t)), pa.array(_pack(tags[t], x, least, most))], ["key", "full", "doc_id", "loc"])


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open anchors with the bytes that their strings may reach beyond the core, or for very large groups the hashes of their strings."""
    names = ["key", "doc_id", "loc", "single", "sides", "hashes"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.int64())]
    for batch in batches:
        b, starts = _bytes(batch.column(1))
        out: list[list] = [[] for _ in names]
        size = 0
        for n, (doc_id, hits) in enumerate(zip(batch.column(0), batch.column(2), strict=True)):
            text = b[starts[n] : starts[n + 1]]
            padded = np.concatenate([np.zeros(A.LAST, np.uint8), text, np.zeros(A.LAST, np.uint8)])
            hits = hits.as_py()
            loc = np.array([h["loc"] for h in hits], dtype=np.int64)
            x, least, most = _unpack(loc)
            hashed = None
            for k, h in enumerate(hits):
                at = int(x[k]) + A.LAST
                sides, hashes = None, None
                if h["m"] > GROUP:
                    o = np.arange(least[k], most[k] + 1)
                    hashed = hashed or A.Hashes(text)
                    hashes = A.mixed(hashed.of(x[k] - o, x[k] - o + A.SPAN)).view(np.int64).tolist()
                else:
                    left = padded[at - A.LAST : at - A.BEFORE].copy()
                    right = padded[at + A.AFTER : at + A.AFTER + A.SIDE]
                    sides = left.tobytes() + right.tobytes()
                for column, v in zip(out, (h["key"], doc_id.as_py(), h["loc"], h["single"], sides, hashes), strict=True):
                    column.append(v)
            size += len(hits)
            if size > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
                out, size = [[] for _ in names], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)


def refine(run: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """One step of interleave refinement: runs split by their members' next symbol, keeping their order; stable, one radix pass by symbol."""
    order = np.argsort(symbol, kind="stable")
    order = order[np.argsort(run[order], kind="stable")]
    r, s = run[order], symbol[order]
    new = np.empty(len(run), dtype=np.int64)
    new[order] = np.cumsum(np.concatenate([[False], (r[1:] != r[:-1]) | (s[1:] != s[:-1])])) if len(run) else 0
    return new


def shared_offsets(group: np.ndarray, sides: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Per aligned string a bit mask of the offsets o (bit o - FIRST) at which its SPAN bytes equal another one's of its group.

    sides: the SIDE bytes before and the SIDE bytes after the core. The interleave of all strings starts as the groups; left[a]
    and right[c] are its runs after a left and c right steps. A string alone in its run is dropped from further steps.
    """
    n = len(group)
    left = [np.unique(group, return_inverse=True)[1].astype(np.int64)]
    right = [left[0]]
    for k in range(A.SIDE):
        left.append(refine(left[-1], sides[:, A.SIDE - 1 - k]))
        right.append(refine(right[-1], sides[:, A.SIDE + k]))
    mask = np.zeros(n, dtype=np.int64)
    for a in range(A.SIDE + 1):
        both = left[a] * np.int64(n + 1) + right[A.SIDE - a]
        own = (least <= a + A.FIRST) & (a + A.FIRST <= most)
        rows = np.flatnonzero(own)
        if len(rows) < 2:
            continue
        v = both[rows]
        order = np.argsort(v, kind="stable")
        w = v[order]
        same = w[1:] == w[:-1]
        hit = np.zeros(len(w), bool)
        hit[1:] |= same
        hit[:-1] |= same
        mask[rows[order[hit]]] |= np.int64(1) << np.int64(a)
    return mask


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; whole groups are settled together, some thousands of strings at a time."""
    carry: list[pa.RecordBatch] = []

    def done(rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch | pa.Table]:
        key = rows.column("key").to_numpy()
        stop = len(key)
        if not last:
            other = np.flatnonzero(key != key[-1])
            stop = int(other[-1]) + 1 if len(other) else 0
        if stop:
            part = rows.slice(0, stop)
            sides = np.frombuffer(b"".join(part.column("sides").to_pylist()), dtype=np.uint8).reshape(stop, 2 * A.SIDE)
            loc = part.column("loc").to_numpy()
            _, least, most = _unpack(loc)
            mask = shared_offsets(key[:stop], sides, least, most)
            keep = np.flatnonzero(part.column("single").to_numpy(zero_copy_only=False).astype(bool) & (mask != 0))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").combine_chunks().take(pa.array(keep)), pa.array(loc[keep]), pa.array(mask[keep])], ["doc_id", "loc", "mask"])
        yield rows.slice(stop)

    n = 0
    for batch in batches:
        carry.append(batch)
        n += len(batch)
        if n >= 8192:
            *found, rest = done(pa.Table.from_batches(carry), False)
            yield from found
            carry, n = rest.to_batches(), 0
    if carry:
        *found, _ = done(pa.Table.from_batches(carry), True)
        yield from found


def _covered(n: int, hits: list[dict]) -> np.ndarray:
    """Sorted disjoint spans (start, stop) of a text of n bytes."""
    loc = np.array([h["loc"] for h in hits], dtype=np.int64)
    mask = np.array([h["mask"] for h in hits], dtype=np.int64)
    x, least, most = _unpack(loc)
    edge = np.zeros(n + 1, dtype=np.int32)
    whole = mask == ALL
    np.add.at(edge, (x - most)[whole], 1)
    np.add.at(edge, (x - least)[whole] + A.SPAN, -1)
    for a in range(A.SIDE + 1) if not whole.all() else ():
        at = x[~whole & ((mask >> a) & 1 == 1)] - (a + A.FIRST)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + A.SPAN, -1)
    inside = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    flips = np.flatnonzero(inside[1:] != inside[:-1])
    return flips.reshape(-1, 2)


def _cut_out(decode: bool):
    return lambda batches: _cut_batches(batches, decode)


def _cut_batches(batches: Iterator[pa.RecordBatch], decode: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        b, starts = _bytes(batch.column(1))
        hits = batch.column(2).to_pylist()
        spans, kept = [], []
        for n in range(len(batch)):
            text = b[starts[n] : starts[n + 1]]
            found = _covered(len(text), hits[n]) if hits[n] else np.zeros((0, 2), np.int64)
            spans.append([{"start": int(s), "stop": int(e)} for s, e in found])
            if len(found):
                keep = np.ones(len(text), bool)
                for s, e in found:
                    keep[s:e] = False
                text = text[keep]
            kept.append(text.tobytes().decode("utf-8", "ignore") if decode else text.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(starts)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.string() if decode else pa.binary()), *(batch.column(k) for k in range(3, batch.num_columns))], ["doc_id", "n_bytes", "spans", "kept", *batch.schema.names[3:]])


def _repeated(found: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, loc, mask = ALL) of the anchors whose whole string occurs twice or more.

    Rows of a key that is not hot meet their strings by an ordinary join. Those of a hot key are first held against the hot
    strings (at most of_key / HOT of them a key), dealt over the key's parts, and only the rest goes through the ordinary join:
    no string brings more rows into a task than of_key / SALTS or HOT, whichever is more.
    """
    parts = F.least(F.lit(SALTS), F.ceil(F.col("of_key") / HOT)).cast("int")
    cold, hot = found.where(F.col("of_key") <= HOT), found.where(F.col("of_key") > HOT)
    often = texts.where(F.col("n") > HOT).select("key", "full", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    hot = hot.withColumn("part", F.pmod(F.xxhash64("doc_id", "loc"), parts).cast("int"))
    on = ["key", "full", "part"]
    rest = cold.unionByName(hot.join(often, on, "left_anti").select(*cold.columns)).join(texts.where(f"n > 1 and n <= {HOT}").select("key", "full"), on[:2], "left_semi")
    return hot.join(often, on, "left_semi").select("doc_id", "loc").unionByName(rest.select("doc_id", "loc")).withColumn("mask", F.lit(ALL).cast("long"))


def hits(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, hits array<struct<loc, mask>>): per document the anchors of its repeated strings."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.shiftrightunsigned(F.xxhash64("text"), 44).alias("tag"), F.col("text").cast("string").alias("text"))
    rows = d.mapInArrow(_emit, "key long, full long, doc_id long, loc long")
    # Written first, so that the join has a shuffle of its own on either side and Spark can split a key that very many strings share.
    keys = stash(rows.groupBy("key").agg(F.count("*").alias("of_key")).where("of_key > 1"))
    found = stash(rows.join(keys, "key").select("key", "full", "doc_id", "loc", "of_key"))

    texts = found.groupBy("key", "full").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "loc")).alias("one"), F.max("of_key").alias("of_key"))
    texts = stash(texts)
    mixed = stash(texts.groupBy("key").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1").select("key", "m"))
    tag = F.shiftrightunsigned("loc", 44).alias("tag")
    open_ = texts.join(mixed, "key").select("key", "one.doc_id", "one.loc", (F.col("n") == 1).alias("single"), "m")
    open_ = open_.groupBy("doc_id", tag).agg(F.collect_list(F.struct("key", "loc", "single", "m")).alias("open"))
    texted = d.join(open_.withColumnRenamed("doc_id", "_id").withColumnRenamed("tag", "_tag"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag")))
    # Repeated rows of one document bring its open strings twice: one of each is enough.
    context = texted.select("doc_id", "text", "open").mapInArrow(_context_rows, "key long, doc_id long, loc long, single boolean, sides binary, hashes array<long>")
    context = stash(context)
    small = context.where("sides is not null").select("key", "doc_id", "loc", "single", "sides").repartition("key").sortWithinPartitions("key", "loc").mapInArrow(_settle, "doc_id long, loc long, mask long")
    o = F.expr(f"((shiftright(loc, 0) & 63) + {A.FIRST})")
    windows = context.where("hashes is not null").select("key", "doc_id", "loc", "single", F.posexplode("hashes").alias("k", "hash")).withColumn("bit", (o + F.col("k") - A.FIRST).cast("int")).withColumn("w", F.xxhash64("key", "bit", "hash"))
    shared = windows.groupBy("w").count().where("count > 1").select("w")
    large = windows.where("single").join(shared, "w").groupBy("doc_id", "loc").agg(F.sum(F.expr("shiftleft(1L, bit)")).alias("mask"))

    every = _repeated(found, texts).unionByName(small).unionByName(large)
    return every.groupBy("doc_id", tag).agg(F.collect_list(F.struct("loc", "mask")).alias("hits"))


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = (), decode: bool = False) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) and the columns named in keep: the UTF-8 bytes of docs(doc_id, text) without those covered
    by a 200-byte string that also starts elsewhere in the corpus.

    Strings are judged on the input; matches never cross documents; overlaps count. Null text is empty. Repeated rows are
    further copies. An empty table gives no rows. Texts under 200 bytes come back whole. Keys are 64-bit hashes of 139 bytes,
    confirmed by an independent 64-bit hash of all 200 to 261 bytes or byte by byte. With decode, kept is text, without the bytes of characters cut in two.
    """
    found = stash(hits(docs).withColumnRenamed("doc_id", "_id").withColumnRenamed("tag", "_tag"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.shiftrightunsigned(F.xxhash64("text"), 44).alias("_t"), F.col("text").cast("string").alias("text"), *[F.col(k).alias(f"_k{n}") for n, k in enumerate(keep)])
    d = d.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_tag")), "left")
    more = "".join(f", _k{n} {docs.schema[k].dataType.simpleString()}" for n, k in enumerate(keep))
    out = d.select("doc_id", "text", "hits", *[f"_k{n}" for n in range(len(keep))]).mapInArrow(_cut_out(decode), f"doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept {'string' if decode else 'binary'}{more}")
    return out.select("doc_id", "n_bytes", "spans", "kept", *[F.col(f"_k{n}").alias(k) for n, k in enumerate(keep)])


def brute(texts: list[str | None], span: int = A.SPAN) -> list[list[tuple[int, int]]]:
    """Spans by definition, for tests."""
    from collections import Counter

    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + span] for b in raw for i in range(len(b) - span + 1))
    out = []
    for b in raw:
        inside = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - span + 1):
            if count[b[i : i + span]] > 1:
                inside[i + 1 : i + 1 + span] = True
        flips = np.flatnonzero(inside[1:] != inside[:-1])
        out.append([(int(s), int(e)) for s, e in flips.reshape(-1, 2)])
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
