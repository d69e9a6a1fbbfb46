"""Approximate nearest neighbours: stable projections to a few dimensions, a kd-tree over them, a chi-square stopping test."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

DIMENSIONS = 24
LEAF = 32
#: Rows of an index block and of a query block, cells of the index at most, and rows (at most) that the cells are fitted on.
ROWS, QUERIES, CELLS, SAMPLE = 16_384, 16_384, 256, 16_384
#: The search of a query ends once a nearer row would have been found already with this probability.
CONFIDENCE = 0.95
#: Leaves that are opened, and projected neighbours that are verified, at a time.
OPEN, VERIFY = 64, 512


def chi_square(x: np.ndarray, m: int = DIMENSIONS) -> np.ndarray:
    """P[chi-square of m (even) degrees of freedom <= x], in closed form."""
    h = np.minimum(x, 1400.0) / 2
    term, total = np.ones_like(h), np.ones_like(h)
    for i in range(1, m // 2):
        term = term * h / i
        total = total + term
    return 1 - np.exp(-h) * total


def quantile(p: float, m: int = DIMENSIONS) -> float:
    """The x at which chi_square reaches p."""
    low, high = 0.0, 1400.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(np.array(mid), m) < p else (low, mid)
    return high


def projection(dim: int, m: int = DIMENSIONS) -> np.ndarray:
    """A fixed matrix of independent normal (2-stable) entries: squared projected over squared true distance is chi-square of m degrees."""
    return np.random.default_rng(1009 + dim).standard_normal((dim, m))


class Tree:
    """A kd-tree as its leaves: median splits of the widest side until LEAF rows are left, with each leaf's bounding box."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        leaves, todo = [], [(0, len(points))]
        while todo:
            lo, hi = todo.pop()
            if hi - lo <= LEAF:
                leaves.append((lo, hi))
                continue
            rows = self.order[lo:hi]
            axis = int(np.argmax(np.ptp(points[rows], axis=0)))
            mid = (hi - lo) // 2
            self.order[lo:hi] = rows[np.argpartition(points[rows, axis], mid)]
            todo += [(lo, lo + mid), (lo + mid, hi)]
        leaves.sort()
        self.starts, self.stops = (np.array(c) for c in zip(*leaves, strict=True))
        self.low = np.array([points[self.order[a:b]].min(axis=0) for a, b in leaves])
        self.high = np.array([points[self.order[a:b]].max(axis=0) for a, b in leaves])

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distances from a projected query to the leaves' boxes."""
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        return (gap * gap).sum(axis=1)


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, confidence: float = CONFIDENCE, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """k neighbours of each query, (row, cosine), padded with (-1, -inf), and how many rows were verified in all. A query's own id is no
    neighbour; equal cosines go to the smaller id.

    Projected neighbours come in order of their projected distance r: leaves are opened in order of their boxes' distances,
    and a row's turn comes when no unopened leaf can hold a nearer one. Each is verified by its true distance, until
    chi_square(r^2 / d_k^2) reaches `confidence`, d_k being the k-th true distance so far (or that of the cosine `known` from
    elsewhere, if that is less).
    """
    a = projection(vectors.shape[1])
    norm, query_norm = np.linalg.norm(vectors, axis=1), np.linalg.norm(queries, axis=1)
    points = vectors / norm[:, None] @ a
    tree = Tree(points)
    points = points[tree.order]
    sizes = tree.stops - tree.starts
    reaches = quantile(confidence)
    n, verified = len(queries), 0
    best_row, best = np.full((n, k), -1), np.full((n, k), -np.inf)
    for i in range(n):
        q = queries[i] / query_norm[i] @ a
        reach = tree.distances(q)
        leaves = np.argsort(reach)
        edge = np.append(reach[leaves], np.inf)
        least = -np.inf if known is None else known[i]
        top_row, top = best_row[i], best[i]
        opened, row, r2 = 0, np.zeros(0, np.int64), np.zeros(0)
        while True:
            stop = max(2 - 2 * max(top[-1], least), 1e-12) * reaches
            sure = r2 < min(edge[opened], stop)
            if edge[opened] < stop and sure.sum() < VERIFY:
                new = leaves[opened : opened + OPEN]
                at = np.repeat(tree.starts[new] - np.cumsum(sizes[new]) + sizes[new], sizes[new]) + np.arange(sizes[new].sum())
                gap = points[at] - q
                row, r2 = np.concatenate([row, at]), np.concatenate([r2, (gap * gap).sum(axis=1)])
                opened += len(new)
                continue
            ready = np.flatnonzero(sure)
            if not len(ready):
                break
            if len(ready) > VERIFY:
                ready = ready[np.argpartition(r2[ready], VERIFY)[:VERIFY]]
            take = tree.order[row[ready]]
            verified += len(take)
            rest = np.ones(len(row), bool)
            rest[ready] = False
            row, r2 = row[rest], r2[rest]
            take = take[ids[take] != query_ids[i]]
            # Exactly the measure, on the original vectors in double precision: what is cut here is ranked as in the result.
            score = np.concatenate([top, np.einsum("wd,d->w", vectors[take], queries[i]) / (query_norm[i] * norm[take])])
            take = np.concatenate([top_row, take])
            first = np.lexsort((ids[take], -score))[:k]
            top_row, top = take[first], score[first]
        best_row[i], best[i] = top_row, top
    return best_row, best, verified


class Cells:
    """Regions of the projected space: median splits of a sample along its widest side until there are `n` of them."""

    def __init__(self, sample: np.ndarray, n: int):
        self.splits: list[tuple[int, float, int, int]] = []  # (axis, value, cell or ~split below, the same from the value on)
        self.n = 0
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.root = self._split(sample, n, np.full(DIMENSIONS, -np.inf), np.full(DIMENSIONS, np.inf))

    def _split(self, x: np.ndarray, n: int, low: np.ndarray, high: np.ndarray) -> int:
        axis = int(np.argmax(np.ptp(x, axis=0))) if len(x) else 0
        value = float(np.median(x[:, axis])) if len(x) else 0.0
        below = x[:, axis] < value
        if n < 2 or not below.any():
            self.low.append(low)
            self.high.append(high)
            self.n += 1
            return self.n - 1
        at = len(self.splits)
        self.splits.append((axis, value, 0, 0))
        cut_high, cut_low = high.copy(), low.copy()
        cut_high[axis] = cut_low[axis] = value
        self.splits[at] = (axis, value, self._split(x[below], n // 2, low, cut_high), self._split(x[~below], n - n // 2, cut_low, high))
        return ~at

    def of(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.root)
        while (inner := np.flatnonzero(out < 0)).size:
            for s in np.unique(out[inner]):
                axis, value, below, above = self.splits[~s]
                rows = np.flatnonzero(out == s)
                out[rows] = np.where(x[rows, axis] < value, below, above)
        return out

    def within(self, q: np.ndarray, r2: np.ndarray) -> Iterator[np.ndarray]:
        """For each projected query the cells at a squared distance below r2."""
        low, high = np.array(self.low), np.array(self.high)
        for x, r in zip(q, r2, strict=True):
            gap = np.maximum(np.maximum(low - x, x - high), 0)
            yield np.flatnonzero((gap * gap).sum(axis=1) < r)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _scaled(m: np.ndarray) -> np.ndarray:
    """Rows whose squares would leave the range of doubles are divided by their largest component; cosines stay the same."""
    top = np.abs(m).max(axis=1, keepdims=True)
    return m / np.where((top > 1e100) | (top < 1e-100), top, 1.0)


def _projected(column: pd.Series) -> np.ndarray:
    x = _scaled(_matrix(column))
    return x / np.linalg.norm(x, axis=1, keepdims=True) @ projection(x.shape[1])


def _nearest(k: int, confidence: float):
    def run(key: tuple, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        x, q = _scaled(_matrix(rows["v"])), _scaled(_matrix(queries["qv"]))
        ids, qids = rows["id"].to_numpy(), queries["qid"].to_numpy()
        row, score, _ = search(ids, x, qids, q, k, confidence, queries["known"].to_numpy())
        i, j = np.nonzero(row >= 0)
        return pd.DataFrame({"query_id": qids[i], "vec_id": ids[row[i, j]], "score": score[i, j]})

    return run


def _celled(cells: dict[int, Cells]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            d["cell"] = np.int32(0)
            for dim, c in cells.items():
                rows = (d["dim"] == dim).to_numpy()
                if rows.any():
                    d.loc[rows, "cell"] = c.of(_projected(d.loc[rows, "v"])).astype(np.int32)
            yield d

    return run


def _routed(cells: dict[int, Cells], confidence: float):
    """Queries (qdim, qid, qv, known, ...) once for each cell that the stopping test does not rule out."""
    reaches = quantile(confidence)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            to = np.empty(len(d), dtype=object)
            to[:] = [np.zeros(1, np.int32)] * len(d)
            for dim, c in cells.items():
                rows = np.flatnonzero((d["qdim"] == dim).to_numpy())
                if len(rows):
                    r2 = np.maximum(2 - 2 * d["known"].to_numpy()[rows], 1e-12) * reaches
                    to[rows] = [x.astype(np.int32) for x in c.within(_projected(d["qv"].iloc[rows]), r2)]
            d["to"] = to
            yield d

    return run


def usable(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v array<double>, dim) of the rows that take part: id and vector not null, some component not zero, none null or not finite."""
    d = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    d = d.where(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))).where(F.exists("v", lambda x: x != 0))
    return d.withColumn("dim", F.size("v"))


def nearest(vectors: DataFrame, is_query, k: int = 5, id: str = "vec_id", vector: str = "embedding", confidence: float = CONFIDENCE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that meets is_query (a condition on `id`), its k rows of largest cosine found.

    Every usable row (see `usable`) is indexed; rows of different length never meet. Vectors of a length that has more than
    ROWS of them are dealt to cells of the projected space (at most CELLS, fitted on at most about SAMPLE rows chosen by a hash), a cell's
    rows to index blocks of about ROWS. A query first searches one block of its own cell; the k-th distance found there rules
    out the cells that fail the stopping test, and it searches all other blocks of those that remain. The k best of
    each query over all blocks are returned. Equal scores go to the smaller id; a repeated id is a candidate as often as it occurs, but not of its own
    queries, and a repeated query is one (of different vectors of one length, the least). Fewer candidates than k give fewer
    rows; an empty table none; other columns are ignored.
    """
    d = usable(vectors, id, vector)
    large = [(r.dim, r["count"]) for r in d.groupBy("dim").count().where(F.col("count") > ROWS).collect()]  # one row a length
    cells = {}
    for dim, n in large:
        some = d.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("id", F.lit(5)), F.lit(-(-n // SAMPLE))) == 0)).orderBy(F.xxhash64("id", F.lit(6))).limit(SAMPLE).select("v").toPandas()
        cells[dim] = Cells(_projected(some["v"]), min(CELLS, -(-n // ROWS))) if len(some) else Cells(np.zeros((0, DIMENSIONS)), 1)
    d = cut(d.mapInPandas(_celled(cells), "id long, v array<double>, dim int, cell int"))
    # One row a cell, so at most CELLS a vector length.
    parts = F.expr(f"(count(*) + {ROWS - 1}) div {ROWS}")
    shape = cut(d.groupBy("dim", "cell").agg(parts.alias("parts")))
    spread = lambda c, seed, n: F.pmod(F.xxhash64(c, F.lit(seed)), F.col(n))
    rows = d.join(F.broadcast(shape), ["dim", "cell"]).withColumn("part", spread("id", 1, "parts"))
    queries = d.where(is_query(F.col("id"))).groupBy(F.col("dim").alias("qdim"), F.col("id").alias("qid")).agg(F.min(F.struct("v", "cell")).alias("m"))
    queries = queries.select("qdim", "qid", F.col("m.v").alias("qv"), F.col("m.cell").alias("own"))
    ask = queries.join(F.broadcast(shape.select(F.col("dim").alias("qdim"), F.col("cell").alias("own"), "parts")), ["qdim", "own"])
    ask = cut(ask.select("qdim", "qid", "qv", "own", spread("qid", 2, "parts").alias("own_part")))

    def found(asked: DataFrame) -> DataFrame:
        """asked(qdim, qcell, qpart, qid, qv, known) met with the rows of those blocks; a block's queries are dealt to query blocks."""
        n = asked.groupBy("qdim", "qcell", "qpart").count().select(F.col("qdim").alias("dim"), F.col("qcell").alias("cell"), F.col("qpart").alias("part"), F.expr(f"(count + {QUERIES - 1}) div {QUERIES}").alias("nq"))
        r = rows.join(n, ["dim", "cell", "part"]).select("dim", "cell", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1)).alias("qb"), "id", "v")
        a = asked.join(n, (F.col("qdim") == F.col("dim")) & (F.col("qcell") == F.col("cell")) & (F.col("qpart") == F.col("part"))).select("qdim", "qcell", "qpart", spread("qid", 3, "nq").alias("qq"), "qid", "qv", "known")
        met = r.groupBy("dim", "cell", "part", "qb").cogroup(a.groupBy("qdim", "qcell", "qpart", "qq"))
        return met.applyInPandas(_nearest(k, confidence), "query_id long, vec_id long, score double")

    least = F.lit(float("-inf"))
    first = cut(found(ask.select("qdim", F.col("own").alias("qcell"), F.col("own_part").alias("qpart"), "qid", "qv", least.alias("known"))))
    known = first.groupBy(F.col("query_id").alias("qid")).agg(F.when(F.count("*") >= k, F.min("score")).otherwise(least).alias("known"))
    # A query of no neighbours so far has no row there.
    ask = ask.join(known, "qid", "left").withColumn("known", F.coalesce("known", least))
    ask = ask.mapInPandas(_routed(cells, confidence), "qid long, qdim int, qv array<double>, own int, own_part long, known double, to array<int>")
    ask = ask.withColumn("qcell", F.explode("to")).join(F.broadcast(shape.select(F.col("dim").alias("qdim"), F.col("cell").alias("qcell"), "parts")), ["qdim", "qcell"])
    ask = ask.withColumn("qpart", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("qcell <> own or qpart <> own_part")
    every = first.unionByName(found(cut(ask.select("qdim", "qcell", "qpart", "qid", "qv", "known"))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


SQL = """
with v as (select vec_id, embedding::double[64] e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select q.vec_id query_id, c.vec_id, array_cosine_similarity(q.e, c.e) score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, rank::integer rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from p) where rank <= 5
"""
