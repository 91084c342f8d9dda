"""Outlines as arrays of edges: containment, distance and boxes, as column expressions.

Rings are array<array<struct<x, y>>> in degrees, closed or not, holes included: a place is inside where a ray crosses an
odd number of edges.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edges_of(rings: Column) -> Column:
    """array<struct<x1, y1, x2, y2>>: the edges of all rings; a ring that isn't closed is."""

    def of(ring: Column) -> Column:
        to = lambda i: F.element_at(ring, ((i + 1) % F.size(ring) + 1).cast("int"))
        # Names as literals: aliases within a lambda are lost beside a generator.
        return F.transform(ring, lambda p, i: F.named_struct(F.lit("x1"), p["x"], F.lit("y1"), p["y"], F.lit("x2"), to(i)["x"], F.lit("y2"), to(i)["y"]))

    return F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) > 0), of))


def bounds(rings: Column) -> tuple[Column, Column, Column, Column]:
    """South, north, west and east of the rings."""
    places = F.flatten(rings)
    xs, ys = F.transform(places, lambda p: p["x"]), F.transform(places, lambda p: p["y"])
    return F.array_min(ys), F.array_max(ys), F.array_min(xs), F.array_max(xs)


def inside(x: Column, y: Column, edges: Column) -> Column:
    """Whether a place is inside: an edge counts from its lower end up to, without, its upper end."""

    def crossed(e: Column) -> Column:
        return ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])

    return F.size(F.filter(edges, crossed)) % 2 == 1


def distance(x: Column, y: Column, edges: Column) -> Column:
    """Least distance of a place from the outline, in the units of the places."""

    def off(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        along = F.coalesce(((x - e["x1"]) * dx + (y - e["y1"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
        along = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
        px, py = x - e["x1"] - along * dx, y - e["y1"] - along * dy
        return F.sqrt(px * px + py * py)

    return F.array_min(F.transform(edges, off))


def meets_box(south: Column, north: Column, west: Column, east: Column, edges: Column) -> Column:
    """Whether a box and the inside or the outline have a place in common."""

    def cut(e: Column) -> Column:
        apart = (F.greatest(e["x1"], e["x2"]) < west) | (F.least(e["x1"], e["x2"]) > east) | (F.greatest(e["y1"], e["y2"]) < south) | (F.least(e["y1"], e["y2"]) > north)
        side = [(e["x2"] - e["x1"]) * (b - e["y1"]) - (e["y2"] - e["y1"]) * (a - e["x1"]) for a in (west, east) for b in (south, north)]
        return ~apart & (F.least(*side) <= 0) & (F.greatest(*side) >= 0)

    return F.exists(edges, cut) | inside(west, south, edges)
