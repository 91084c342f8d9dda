"""Outlines with holes, shared corners, boxes around and inside."""

import duckdb
import pytest

from tscausal import catalog
from tscausal.operators import screening
from tscausal.sources import grid

SHAPE = "area string, rings array<array<struct<x:double,y:double>>>, size double"
SQUARE = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
HOLE = [(0.4, 0.4), (0.6, 0.4), (0.6, 0.6), (0.4, 0.6), (0.4, 0.4)]


@pytest.fixture(scope="module")
def outlines(spark):
    notch = [(2.0, 0.0), (3.0, 0.0), (2.2, 0.5), (3.0, 1.0), (2.0, 1.0)]
    return spark.createDataFrame([("ring", [SQUARE, HOLE], 5.0), ("small", [[(0.1, 0.1), (0.3, 0.1), (0.3, 0.3), (0.1, 0.3)]], 1.0), ("notch", [notch], 2.0), ("none", [], 9.0), ("null", None, 9.0)], SHAPE)


def test_points_in_outlines(spark, outlines):
    places = {"both": (0.2, 0.2), "hole": (0.5, 0.5), "brim": (0.42, 0.5), "near": (1.04, 0.5), "far": (1.06, 0.5), "bay": (2.6, 0.5), "land": (2.1, 0.5), "nowhere": (None, None)}
    points = spark.createDataFrame([(k, y, x) for k, (x, y) in places.items()], "point string, lat double, lon double")
    found = {r.point: (r.area, r.relation) for r in screening.holding_outline(points, outlines).collect()}
    assert found == {"both": ("ring", "contains"), "brim": ("ring", "near"), "near": ("ring", "near"), "land": ("notch", "contains")}


def test_squares_of_outlines(spark, outlines):
    cells = {(r.area, round(r.lon, 2), round(r.lat, 2)) for r in grid.cells_of_outline(outlines, 0.25).collect()}
    assert ("notch", 2.88, 0.38) not in cells and ("notch", 2.12, 0.38) in cells and {a for a, _, _ in cells} == {"ring", "small", "notch"}
    inner = {(x, y) for a, x, y in cells if a == "ring" and 0 < x < 1 and 0 < y < 1}
    assert len(inner) == 16
    # A square may lie wholly within an outline, and an outline within a square.
    assert {c[1:] for c in cells if c[0] == "small"} == {(0.12, 0.12), (0.38, 0.12), (0.12, 0.38), (0.38, 0.38)}
    assert {r.area for r in grid.cells_of_outline(outlines.where("area = 'small'"), 5.0).collect()} == {"small"}
    hollow = spark.createDataFrame([("wide", [SQUARE, [(0.05, 0.05), (0.95, 0.05), (0.95, 0.95), (0.05, 0.95)]], 1.0)], SHAPE)
    assert (0.45, 0.45) not in {(round(r.lon, 2), round(r.lat, 2)) for r in grid.cells_of_outline(hollow).collect()}


def test_points_just_as_far_as_the_limit(spark, tmp_path):
    """The corners of the boxes lie where the decimals of the SQL have them: supplier 370 is 0.05 degrees from area 17."""
    spark.range(25).selectExpr("cast(id AS int) AS n_nationkey").write.parquet(f"{tmp_path}/nation.parquet")
    for table, key in (("supplier", "s_suppkey"), ("customer", "c_custkey")):
        spark.range(1000).selectExpr(f"id AS {key}", f"'x' AS {key[0]}_name", f"0 AS {key[0]}_nationkey").write.parquet(f"{tmp_path}/{table}.parquet")
    with duckdb.connect() as duck:
        for table in ("nation", "supplier", "customer"):
            duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        want = sorted(duck.sql(catalog.ORACLE_SQL["containing_area"]).fetchall())
    assert (370, 17, "near") in want and sorted(tuple(r) for r in catalog.QUERIES["containing_area"](spark, str(tmp_path)).collect()) == want
