"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from strandline.plans import catalog

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        if (DATA / f"{t}.parquet").exists():
            c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, duck, name):
    import pandas as pd

    got, want = catalog.QUERIES[name](spark, str(DATA)).toPandas(), duck.execute(catalog.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    order = lambda d: d[columns].sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, str(DATA)).count() > 0


def brute_levels(pairs, seed):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    level, edge = {seed: 0}, [seed]
    while edge:
        edge = sorted({y for x in edge for y in near.get(x, ())} - level.keys())
        level |= dict.fromkeys(edge, level[max(level, key=level.get)] + 1)
    return level


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_bfs_without_limit(spark, monkeypatch):
    from strandline.plans.views import Views

    pairs = [tuple(r) for r in Views(spark, str(DATA)).links.select("src", "dst").distinct().collect()]
    got = {r.node: r.level for r in catalog.QUERIES["bfs_all"](spark, str(DATA)).collect()}
    assert got == brute_levels(pairs, "p0")
    # A graph of more than two levels: a long chain with a branch, and a part that can't be reached.
    chain = [(f"p{i}", f"p{i + 1}") for i in range(12)] + [("p3", "x"), ("x", "y"), ("far", "away")]
    links = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(chain)], "src string, dst string, ordinal long").checkpoint()
    nodes = spark.createDataFrame([(n,) for n in sorted({n for e in chain for n in e})], "node string").checkpoint()
    monkeypatch.setattr(Views, "links", links)
    monkeypatch.setattr(Views, "segments", nodes)
    got = {r.node: r.level for r in catalog.QUERIES["bfs_all"](spark, str(DATA)).collect()}
    assert got == brute_levels(chain, "p0") and max(got.values()) == 12


@pytest.mark.parametrize("few", [65_536, 0])
def test_bfs_writes_links_once(spark, monkeypatch, few):
    """Every level reads the written links: the links' own plan is run once, whatever the depth and however frontiers meet them; repeats of links change nothing."""
    from strandline.operators import traverse

    monkeypatch.setattr(traverse, "FEW", few)
    chain = [(f"n{i}", f"n{i + 1}") for i in range(6)] + [("n2", "x"), ("n1", "n1"), ("n1", "y"), ("y", "n2")]
    rows = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(chain)], "src string, dst string, ordinal long").checkpoint()
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    links = rows.unionByName(rows).mapInArrow(seen, rows.schema)
    seeds = spark.createDataFrame([("n0",)], "node string")
    for limit in (None, 100):
        before = reads.value
        got = traverse.bfs(links, seeds, max_nodes=limit).orderBy("level", "position", "node").collect()
        assert {r.node: r.level for r in got} == brute_levels(chain, "n0")
        assert reads.value - before == 2 * len(chain)
        if limit:
            assert [r.node for r in got] == ["n0", "n1", "n2", "y", "n3", "x", "n4", "n5", "n6"] and [r.position for r in got] == list(range(9))


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_region_reads_its_sequence_only(spark):
    """A region's checks, some eight of them, read the sequence's written walks and steps, not the whole tables again."""
    from strandline.plans.views import Views

    v = Views(spark, str(DATA))
    name = catalog._first_sequence(v)
    walks, steps = catalog._on_sequence(v, name)
    for d in (walks, steps):
        assert "parquet" not in d._jdf.queryExecution().optimizedPlan().toString().lower()
    paths = v.walks.where(v.walks.seq_id == name)
    assert sorted(r.name for r in walks.collect()) == sorted(r.name for r in paths.collect())
    want = v.located.join(paths.select("path_id"), "path_id", "left_semi")
    assert {tuple(r) for r in steps.select(want.columns).collect()} == {tuple(r) for r in want.collect()}


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "haplotype_region" in entry.queries()
