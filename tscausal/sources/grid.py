"""Gridded variables: cells of an area, nearest cells, means over an area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry


def cells_in_box(boxes: DataFrame, step: float = 0.1, buffer: float = 0.15) -> DataFrame:
    """(area, lat, lon) of the grid cells whose square meets the buffered box (area, south, north, west, east)."""
    span = lambda a, b: F.sequence(F.ceil((F.col(a) - buffer) / step - 0.5), F.floor((F.col(b) + buffer) / step + 0.5))
    rows = boxes.select("area", F.explode(span("south", "north")).alias("i"), "west", "east")
    return rows.select("area", "i", F.explode(span("west", "east")).alias("j")).select("area", F.round(F.col("i") * step, 6).alias("lat"), F.round(F.col("j") * step, 6).alias("lon"))


def cells_of_outline(outlines: DataFrame, step: float = 0.1) -> DataFrame:
    """(area, lat, lon): centres of the grid squares that have a place in common with an outline (area, rings).

    Squares lie between multiples of ``step``. Outlines without rings have none.
    """
    south, north, west, east = geometry.bounds(F.col("rings"))
    span = lambda a, b: F.sequence(F.floor(a / step) - 1, F.floor(b / step) + 1)
    rows = outlines.where(south.isNotNull() & west.isNotNull()).select("area", geometry.edges_of(F.col("rings")).alias("edges"), F.explode(span(south, north)).alias("i"), span(west, east).alias("js"))
    rows = rows.select("area", "edges", "i", F.explode("js").alias("j"))
    i, j = F.col("i"), F.col("j")
    kept = rows.where(geometry.meets_box(i * step, (i + 1) * step, j * step, (j + 1) * step, F.col("edges")))
    return kept.select("area", F.round((i + 0.5) * step, 6).alias("lat"), F.round((j + 0.5) * step, 6).alias("lon"))


def nearest_cell(x: str | Column, step: float = 0.1) -> Column:
    return F.round(F.floor((F.col(x) if isinstance(x, str) else x) / step + 0.5) * step, 6)


def area_means(grid: DataFrame, cells: DataFrame, step: float = 0.1) -> DataFrame:
    """(area, variable, month, value): mean over an area's points of the nearest cells of ``grid`` (time, lat, lon, variable, value)."""
    points = cells.select("area", nearest_cell("lat", step).alias("lat"), nearest_cell("lon", step).alias("lon"))
    values = grid.select(F.trunc("time", "month").alias("month"), nearest_cell("lat", step).alias("lat"), nearest_cell("lon", step).alias("lon"), "variable", "value")
    return values.join(points, ["lat", "lon"]).groupBy("area", "variable", "month").agg(F.avg("value").alias("value"))
