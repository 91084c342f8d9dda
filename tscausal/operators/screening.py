"""Choosing stations: gauges that match by name, size and distance, and water bodies that hold a point."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.scalars import excluded_direction, haversine_km, name_tokens

# Words of names that say nothing about which water body is meant.
STOP = (
    "LAKE", "LAKES", "LAC", "AT", "NEAR", "OF", "THE", "RIVER", "RIVIERE", "CREEK", "DU", "AU", "LA", "OUTLET", "BELOW", "ABOVE", "DAM",
    "BARRAGE", "A", "EN", "AVAL", "AMONT", "STATION", "GENERATING",
)


def match_outlets(levels: DataFrame, flows: DataFrame, low: float = 0.85, high: float = 1.20, km: float = 100.0) -> DataFrame:
    """For each level gauge the regulated flow gauge whose drainage area fits best, if any.

    Both frames: id, name, region, lat, lon, area; flows also regulated. A candidate lies in the same region within
    ``km``, its area is ``low`` to ``high`` times the gauge's, and its name does not say above or inlet. The pairs form
    inside a region only, and a box of latitudes drops far ones before any trigonometry.
    """
    f = flows.where("regulated = 1").where(~excluded_direction("name")).select("region", *(F.col(c).alias(f"flow_{c}") for c in ("id", "name", "lat", "lon", "area")))
    pairs = levels.where("area > 0").join(f, "region").where((F.col("id") != F.col("flow_id")) & (F.abs(F.col("lat") - F.col("flow_lat")) <= km / 110.0))
    ratio = F.col("flow_area") / F.col("area")
    pairs = pairs.withColumn("ratio", F.round(ratio, 3)).where(ratio.between(low, high))
    pairs = pairs.withColumn("distance_km", haversine_km(F.col("lat"), F.col("lon"), F.col("flow_lat"), F.col("flow_lon"))).where(F.col("distance_km") <= km)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.round(F.abs(F.col("ratio") - 1), 3), "flow_id"))
    best = pairs.withColumn("_k", rank).where("_k = 1")
    shared = F.size(F.array_intersect(name_tokens("name", STOP), name_tokens("flow_name", STOP))) > 0
    return best.select("id", "flow_id", "ratio", "distance_km", F.when(shared | F.col("ratio").between(0.95, 1.05), "high").otherwise("review").alias("confidence"))


def holding_area(points: DataFrame, boxes: DataFrame, near: float = 0.05) -> DataFrame:
    """(point, area, relation): the box that contains a point (the largest such), else the nearest within ``near`` degrees.

    Boxes (area, south, north, west, east, size) stand for outlines: whole degrees of latitude and longitude key the
    join, so that points meet the boxes around them only.
    """
    cells = lambda a, b: F.sequence(F.floor(F.col(a) - near), F.floor(F.col(b) + near))
    tiles = boxes.withColumn("i", F.explode(cells("south", "north"))).withColumn("j", F.explode(cells("west", "east")))
    pairs = points.withColumn("i", F.floor("lat")).withColumn("j", F.floor("lon")).join(tiles, ["i", "j"])
    dy = F.greatest(F.col("south") - F.col("lat"), F.col("lat") - F.col("north"), F.lit(0.0))
    dx = F.greatest(F.col("west") - F.col("lon"), F.col("lon") - F.col("east"), F.lit(0.0))
    pairs = pairs.withColumn("d", F.sqrt(dx * dx + dy * dy)).where(F.col("d") <= near)
    inside = F.col("d") == 0
    rank = F.row_number().over(Window.partitionBy("point").orderBy(F.desc(inside), F.when(inside, -F.col("size")).otherwise(F.col("d")), "area"))
    return pairs.withColumn("_k", rank).where("_k = 1").select("point", "area", F.when(inside, "contains").otherwise("near").alias("relation"))


def holding_outline(points: DataFrame, outlines: DataFrame, near: float = 0.05) -> DataFrame:
    """(point, area, relation): the outline that contains a point (the largest such), else the nearest within ``near`` degrees.

    Points have (point, lat, lon), outlines (area, rings, size). As in ``holding_area`` whole degrees key the join; an
    outline's edges are tested only by points in its bounds. Points without a place and outlines without rings match nothing.
    """
    south, north, west, east = geometry.bounds(F.col("rings"))
    cells = lambda a, b: F.sequence(F.floor(F.col(a) - near), F.floor(F.col(b) + near))
    tiles = outlines.select("area", "size", geometry.edges_of(F.col("rings")).alias("edges"), *(c.alias(n) for c, n in ((south, "south"), (north, "north"), (west, "west"), (east, "east"))))
    tiles = tiles.where("south IS NOT NULL AND west IS NOT NULL").withColumn("i", F.explode(cells("south", "north"))).withColumn("j", F.explode(cells("west", "east")))
    pairs = points.withColumn("i", F.floor("lat")).withColumn("j", F.floor("lon")).join(tiles, ["i", "j"])
    pairs = pairs.where(F.col("lat").between(F.col("south") - near, F.col("north") + near) & F.col("lon").between(F.col("west") - near, F.col("east") + near))
    place = F.col("lon"), F.col("lat"), F.col("edges")
    pairs = pairs.select("point", "area", "size", geometry.inside(*place).alias("inside"), geometry.distance(*place).alias("d")).where((F.col("d") <= near) | F.col("inside"))
    rank = F.row_number().over(Window.partitionBy("point").orderBy(F.desc("inside"), F.when(F.col("inside"), -F.col("size")).otherwise(F.col("d")), "area"))
    return pairs.withColumn("_k", rank).where("_k = 1").select("point", "area", F.when(F.col("inside"), "contains").otherwise("near").alias("relation"))


def regulated_stations(history: DataFrame) -> DataFrame:
    """(station, regulated, periods): whether a station was ever regulated, and its history in order."""
    return history.groupBy("station").agg(F.max("regulated").alias("regulated"), F.sort_array(F.collect_list(F.struct("year_from", "year_to", "regulated"))).alias("periods"))
