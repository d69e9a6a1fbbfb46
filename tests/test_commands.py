"""The command line over a stored index, and the stream ingest."""

from __future__ import annotations

import pytest

from strandline.cli import run
from strandline.streaming.ingest import append_steps

from test_graph import HAPLOTYPES, SMALL, p_rows, repeated


def test_commands(spark, tmp_path, capsys):
    source, index = tmp_path / "g.gfa", str(tmp_path / "index")
    source.write_text("\n".join(repeated()) + "\n")
    assert run(spark, ["index_gfa", str(source), index, "--checkpoint_steps", "2"]) == 0
    (tmp_path / "paths.tsv").write_text("# chosen\nP\tref\n")
    assert run(spark, ["index_coordinates", index, str(tmp_path / "tracks"), "--path_names_file", str(tmp_path / "paths.tsv")]) == 0
    out = tmp_path / "region.gfa"
    run(spark, ["get_region", index, "ref:1-4", str(out), "--tracks", str(tmp_path / "tracks"), "--all_haplotypes", "--with_coords"])
    assert p_rows(out.read_text().splitlines()) == HAPLOTYPES[None][0]
    capsys.readouterr()
    run(spark, ["get_path", index, "--path_id", "ref"])
    assert capsys.readouterr().out == "P\tref\tA+,B+,C+,D+,E+,B+,F+\t*\n"
    run(spark, ["list_coordinates", index, "--tracks", str(tmp_path / "tracks"), "--no_header"])
    assert sorted(x.split("\t")[-1] for x in capsys.readouterr().out.splitlines()) == ["cdx", "on_the_fly", "on_the_fly", "on_the_fly"]
    with pytest.raises(ValueError):
        run(spark, ["index_gfa", str(source), str(tmp_path / "x"), "--checkpoint_steps", "0"])


def test_stream_of_paths(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(2):
        (folder / f"{k}.gfa").write_text("\n".join(SMALL).replace("reference", f"r{k}") + "\n")
        append_steps(spark, str(folder), str(tmp_path / "steps"), str(tmp_path / "mark")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "steps")).count() == 12
