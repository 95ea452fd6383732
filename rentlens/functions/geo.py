"""Planar and spherical geometry on columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .money import as_column

EARTH_RADIUS_MILES = 3958.7613


def planar_distance(x1, y1, x2, y2) -> Column:
    """Straight-line distance in the units of the coordinates."""
    dx, dy = as_column(x1) - as_column(x2), as_column(y1) - as_column(y2)
    return F.sqrt(dx * dx + dy * dy)


def haversine_miles(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in miles on a sphere of mean radius."""
    lat1, lon1, lat2, lon2 = (F.radians(as_column(c)) for c in (lat1, lon1, lat2, lon2))
    half_lat, half_lon = F.sin((lat2 - lat1) / 2), F.sin((lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(lat1) * F.cos(lat2) * half_lon * half_lon
    return F.asin(F.sqrt(F.least(chord, F.lit(1.0)))) * (2 * EARTH_RADIUS_MILES)


def crosses(edge: Column, x: Column, y: Column) -> Column:
    """Does the ray from (x, y) towards growing x cross this edge (struct x1, y1, x2, y2)?

    Half-open: an edge holds its lower end only, so a point on a shared border belongs
    to exactly one side and a box holds its lower and left borders.
    """
    spans = (edge["y1"] > y) != (edge["y2"] > y)
    at = edge["x1"] + F.try_divide((y - edge["y1"]) * (edge["x2"] - edge["x1"]), edge["y2"] - edge["y1"])
    return F.coalesce(spans & (x < at), F.lit(False))


def signed_turns(ring: Column) -> Column:
    """Sum of (ax - bx)(ay + by) over the ring's sides: above zero is counter-clockwise.

    ``ring`` is an array of points (struct x, y); the side back to the start is included.
    """
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    sides = F.zip_with(ring, following, lambda a, b: (a["x"] - b["x"]) * (a["y"] + b["y"]))
    return F.aggregate(sides, F.lit(0.0), lambda total, side: total + side)
