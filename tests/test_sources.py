"""Readers that go on without what fails, stored parameters and results kept by fingerprint."""

import sqlite3

import pytest

from tscausal.operators import screening
from tscausal.sources import files


def test_fetch_leaves_failed_stations_out(spark):
    said = []

    def fetch(station):
        if station == "broken":
            raise OSError("no answer")
        return spark.createDataFrame([(1.0,)] if station == "good" else [], "value double")

    found = files.fetch_stations(["good", "broken", "empty"], fetch, said.append)
    assert [f.first().station for f in found] == ["good"] and len(said) == 2 and "no answer" in said[0]
    with pytest.raises(ValueError, match="none of 2"):
        files.fetch_stations(["broken", "empty"], fetch, said.append)


def test_parameters_fall_back(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"entity": "e", "variable": "x", "size": 5}\n{"entity": "e", "variable": "y", "size": 0, "tau": 2}\n')
    entities = spark.createDataFrame([("e",), ("f",)], "entity string")
    got = {(r.entity, r.variable): (r["size"], r.tau, r.stored) for r in files.read_parameters(spark, str(tmp_path), entities, ["x", "y"]).collect()}
    assert got == {("e", "x"): (5, 1, True), ("e", "y"): (3, 1, False), ("f", "x"): (3, 1, False), ("f", "y"): (3, 1, False)}


def test_results_are_kept_by_fingerprint(spark, tmp_path):
    made = []

    def compute():
        made.append(1)
        return spark.range(3)

    for print_ in ("a", "a", "b"):
        assert files.by_fingerprint(str(tmp_path), print_, compute, spark).count() == 3
    assert len(made) == 2


def test_ancestors_of_long_chains(spark):
    from tscausal.operators import graph

    edges = spark.createDataFrame([("e", f"v{i:02d}", f"v{i + 1:02d}") for i in range(12)] + [("e", "v05", "v02")], "entity string, cause string, effect string")
    assert {r.variable for r in graph.ancestors(edges, ["entity"], "v12").collect()} == {f"v{i:02d}" for i in range(12)}


def test_sqlite_files(spark, tmp_path):
    for name, stations in (("a.db", [("A1", 1, 1950), ("A1", 0, None), ("B2", 0, 1960)]), ("b.db", [("C3", 1, 2000)]), ("empty.db", [])):
        with sqlite3.connect(tmp_path / name) as db:
            db.execute("CREATE TABLE regulation (station TEXT, regulated INTEGER, year_from INTEGER)")
            db.executemany("INSERT INTO regulation VALUES (?, ?, ?)", stations)
        db.close()
    found = files.read_sqlite(spark, str(tmp_path), "SELECT station, regulated, year_from, NULL FROM regulation", "station string, regulated int, year_from int, year_to int", rows=2)
    by_station = {r.station: (r.regulated, len(r.periods)) for r in screening.regulated_stations(found).collect()}
    assert by_station == {"A1": (1, 2), "B2": (0, 1), "C3": (1, 1)}
