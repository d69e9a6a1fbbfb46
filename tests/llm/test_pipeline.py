"""The pipeline's stages on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import corpus_pipeline as P
from strandline.llm import queries

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_stages(spark):
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    seen = []
    for name, stage in P.STAGES:
        docs = stage(spark, docs, str(DATA)).checkpoint()
        seen.append((name, docs.count()))
        if name != P.STAGES[-1][0]:
            assert docs.columns == P.COLUMNS
    n = dict(seen)
    assert 200 > n["quality"] >= n["near_duplicates"] == n["repeated_passages"] > 100
    assert docs.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 1024").count() == 0


ODD = "doc_id long, text string, lang string, source string, n_chars long, text_key int, score double, copies int, _id long, hits int"


def odd_rows():
    a = " ".join(f"word{i}" for i in range(80))
    rows = [(1, a), (7, "x y z and more of this"), (7, "completely different text here"), (None, a), (None, a), (None, "alone without an id"), (None, "alone without an id"), (9, None), (10, ""), (11, a.replace("word40", "other")), (12, a), (12, a), (13, "long " * 60_000)]
    return [(i, t, "en", None if i == 9 else "src", 5, 1, 0.5, 2, 3, 4) for i, t in rows]


def test_near_duplicates_of_odd_rows(spark):
    got = P.near_duplicates(spark, spark.createDataFrame(odd_rows(), ODD), "").collect()
    assert got[0].__fields__ == P.COLUMNS
    texts = sorted(((r.doc_id, r.text) for r in got), key=str)
    want = {(1, odd_rows()[0][1]), (7, "x y z and more of this"), (7, "completely different text here"), (None, "alone without an id"), (9, None), (13, "long " * 60_000)}
    assert len(texts) == len(set(texts)) and set(texts) - {(11, odd_rows()[9][1])} == want


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("n", [0, None])
def test_stages_of_odd_rows(spark, n):
    """Each stage on nulls, repeats, ties, long texts, clashing columns, and on no rows."""
    docs = spark.createDataFrame(odd_rows()[:n], ODD)
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(DATA))
        if name != P.STAGES[-1][0]:
            assert out.columns == P.COLUMNS
        rows = out.count()
        assert rows == 0 if n == 0 else rows == len(odd_rows()) if name == "repeated_passages" else rows > 0, name


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_quality_model_query(spark):
    """held_out and predicted by definition, held-out accuracy; training takes pieces of long texts and never a held-out row."""
    import zlib

    from strandline.llm import quality_model

    rows = queries.QUERIES["op7_quality_model"](spark, str(DATA)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(str(DATA / "labels.parquet")).collect()}
    right = [r.predicted == quality[r.doc_id] for r in rows if r.held_out and r.doc_id in quality]
    assert sum(right) / len(right) > 0.85
    long = " ".join(map(str, range(20_000)))
    docs = spark.createDataFrame([(1, long), (1, long + "z"), (2, "short"), (12, "held out"), (3, None), (4, "unknown")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (12, 1), (3, 1), (4, None), (None, 1)], "doc_id long, quality int")
    assert [i for i in (1, 2, 12) if zlib.crc32(str(i).encode()) % 5 == 0] == [12]
    got = quality_model.training_rows(docs, labels)
    assert sorted(len(t) for t, _ in got) == [5, 8000] and {q for _, q in got} == {1}
    long_one = max((t for t, _ in got), key=len)
    assert all(long_one[k : k + 1000] in long + "z" for k in range(0, 8000, 1000)) and long_one[:1000] == long[:1000]


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    import duckdb
    import pandas as pd

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, str(DATA)).toPandas(), c.execute(queries.SQL[name]).df()
    columns = sorted(want.columns)
    order = lambda d: d[columns].sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)
