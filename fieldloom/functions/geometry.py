"""Boxes, points, lines and places on the globe as column expressions. Boxes are structs x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def area(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0.0)) * F.greatest(b["y2"] - b["y1"], F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def iom(a: Column, b: Column) -> Column:
    """Intersection over the smaller box."""
    least = F.least(area(a), area(b))
    return F.when(least > 0, intersection(a, b) / least).otherwise(0.0)


def inside_fraction(a: Column, window: Column) -> Column:
    return F.when(area(a) > 0, intersection(a, window) / area(a)).otherwise(0.0)


def centre(b: Column) -> Column:
    return F.struct(((b["x1"] + b["x2"]) / 2).alias("x"), ((b["y1"] + b["y2"]) / 2).alias("y"))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    y = F.sin(F.radians(lon2 - lon1)) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon2 - lon1))
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def wrap_deg(d: Column) -> Column:
    """An angle's difference in [-180, 180)."""
    return F.pmod(d + 180.0, F.lit(360.0)) - 180.0


def in_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """Ray casting over an array of structs x, y."""

    def crossed(i: Column) -> Column:
        a, b = F.get(polygon, i - 1), F.get(polygon, F.pmod(i, F.size(polygon)))
        spans = (a["y"] > y) != (b["y"] > y)
        return F.when(spans & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1).otherwise(0)

    n = F.aggregate(F.sequence(F.lit(1), F.size(polygon)), F.lit(0), lambda s, i: s + crossed(i))
    return (F.size(polygon) >= 3) & (n % 2 == 1)


def side_of_line(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.signum((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)).cast("int")


def x_at(points: Column, y: Column) -> Column:
    """x of a polyline (array of structs x, y) at a height, between the two points around it; null outside."""
    by_y = F.array_sort(F.transform(points, lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x"))))
    below = F.element_at(F.filter(by_y, lambda p: p["y"] <= y), -1)
    above = F.get(F.filter(by_y, lambda p: p["y"] >= y), F.lit(0))
    step = above["y"] - below["y"]
    return F.when(step == 0, below["x"]).otherwise(below["x"] + (above["x"] - below["x"]) * (y - below["y"]) / step)


def polyline_length(points: Column) -> Column:
    pairs = F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points)), lambda a, b: F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2)))
    return F.when(F.size(points) > 1, F.aggregate(pairs, F.lit(0.0), lambda s, d: s + d)).otherwise(0.0)


def vehicle_to_world(forward: Column, lateral: Column, lat: Column, lon: Column, heading_rad: Column) -> Column:
    north = forward * F.cos(heading_rad) - lateral * F.sin(heading_rad)
    east = forward * F.sin(heading_rad) + lateral * F.cos(heading_rad)
    return F.struct((lat + F.degrees(north / EARTH_M)).alias("lat"), (lon + F.degrees(east / (EARTH_M * F.cos(F.radians(lat))))).alias("lon"))
