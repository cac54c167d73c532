"""Joins of places on the globe: nearest within a gate, all within a radius, consensus of elements seen more than once.

Places meet in cells: bands of latitude as high as the reach, each divided around the globe into as many cells as are at
least as wide as the reach in that band and its neighbours, so that what is in reach lies in the cell or those beside it,
across the date line and at the poles too. Rows with a null or odd latitude (beyond 90) or longitude meet nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import EARTH_M, haversine_m
from .graph import cut

#: Fixed value: metres of a degree of latitude, for distances in the plane around a point.
DEGREE_M = 111_320.0


def sound(lat: str, lon: str) -> Column:
    return F.col(lat).between(-90.0, 90.0) & F.col(lon).between(-540.0, 540.0) & ~F.isnan(lon)


def band_height(reach_m: float) -> float:
    return max(math.degrees(reach_m / EARTH_M) * (1 + 1e-9), 1e-7)


def cells_around(band: Column, reach_m: float) -> Column:
    """How many cells a band has."""
    height = band_height(reach_m)
    farthest = F.least(F.lit(90.0), F.greatest(F.abs((band - 1) * height), F.abs((band + 2) * height)))
    narrow = F.greatest(F.cos(F.radians(farthest)), F.lit(0.0))
    half = math.sin(min(math.pi / 2, reach_m / EARTH_M / 2)) * (1 + 1e-9)
    width = 2 * F.degrees(F.asin(F.least(F.lit(1.0), half / F.greatest(narrow, F.lit(1e-12)))))
    return F.greatest(F.floor(F.least(360.0 / F.greatest(width, F.lit(1e-7)), F.lit(2e9))), F.lit(1)).cast("long")


def with_cell(df: DataFrame, lat: str, lon: str, reach_m: float) -> DataFrame:
    """Adds _band and _cell, without the rows that meet nothing."""
    df = df.where(sound(lat, lon)).withColumn("_band", F.floor(F.col(lat) / band_height(reach_m)).cast("long"))
    n = cells_around(F.col("_band"), reach_m)
    return df.withColumn("_cell", F.pmod(F.floor((F.col(lon) + 180.0) / 360.0 * n), n).cast("long"))


def with_cells_in_reach(df: DataFrame, lat: str, lon: str, reach_m: float) -> DataFrame:
    """A row for each cell that may hold something in reach: up to three in each of three bands."""
    df = df.where(sound(lat, lon)).withColumn("_band", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: F.floor(F.col(lat) / band_height(reach_m)).cast("long") + k)))
    n = cells_around(F.col("_band"), reach_m)
    own = F.floor((F.col(lon) + 180.0) / 360.0 * n)
    return df.withColumn("_cell", F.explode(F.array_distinct(F.array(*(F.pmod(own + k, n).cast("long") for k in (-1, 0, 1))))))


def within(points: DataFrame, places: DataFrame, reach_m: float, *same: str) -> DataFrame:
    """(id, other, metres) of all pairs in reach that are equal in the columns `same`. Both sides: id, lat, lon; ids are
    unique on each."""
    a = with_cells_in_reach(points.select("id", "lat", "lon", *same), "lat", "lon", reach_m)
    b = with_cell(places.select(F.col("id").alias("other"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), *same), "lat2", "lon2", reach_m)
    both = a.join(b, ["_band", "_cell", *same]).withColumn("metres", haversine_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")))
    return both.where(F.col("metres") <= reach_m).select("id", "other", "metres")


def nearest(points: DataFrame, places: DataFrame, gate_m: float, finer: int = 3) -> DataFrame:
    """(id, other, metres): the nearest place of each point within the gate, of equal ones the smaller id; else nulls.

    Points and places of one spot are one. The search begins with a reach of the gate / 4 ** finer, and only points
    that found nothing go on to four times the reach, so crowded places never meet as all pairs within the gate."""
    spot = ["lat", "lon"]
    usable = places.where(sound("lat", "lon") & F.col("id").isNotNull())
    usable = cut(usable.groupBy(*spot).agg(F.min("id").alias("id")))
    left = cut(points.where(sound("lat", "lon")).select(*spot).distinct().withColumn("id", F.struct(*spot)))
    found = None
    for k in range(finer, -1, -1):
        best = within(left, usable, gate_m / 4**k).groupBy("id").agg(F.min(F.struct("metres", "other")).alias("best"))
        best = cut(best.select("id", "best.other", "best.metres"))
        found = best if found is None else found.unionByName(best)
        left = left.join(best.select("id"), "id", "left_anti")
    found = found.select("id.lat", "id.lon", "other", "metres")
    return points.select("id", *spot).join(found, spot, "left").select("id", "other", "metres")


def turned(lon: Column) -> Column:
    """A difference of longitudes the short way around; what is short already stays as it is, to the last bit."""
    once = F.when(F.abs(lon) <= 180.0, lon).when((lon > 180.0) & (lon <= 540.0), lon - 360.0).when((lon < -180.0) & (lon >= -540.0), lon + 360.0)
    return once.otherwise(F.pmod(lon + 180.0, F.lit(360.0)) - 180.0)


def nearest_line(points: DataFrame, lines: DataFrame, gate_m: float, finer: int = 1) -> DataFrame:
    """(id, line, metres): the nearest of the lines' stretches (id, lat1, lon1, lat2, lon2; several rows may have one id)
    within the gate, in the plane around the point; of equal ones the smaller id, else nulls.

    Points of one spot are one, and so are stretches with the same ends. The search begins with a reach of the gate /
    4 ** finer, and only points that found nothing go on to four times the reach. Stretches are cut into pieces no longer
    than the reach, each met by its middle; what is measured is the whole stretch."""
    spot, ends = ["lat", "lon"], ["lat1", "lon1", "lat2", "lon2"]
    usable = lines.where(sound("lat1", "lon1") & sound("lat2", "lon2") & F.col("id").isNotNull()).groupBy(*ends).agg(F.min("id").alias("line"))
    usable = usable.withColumn("turn", turned(F.col("lon2") - F.col("lon1")))
    usable = cut(usable.withColumn("long", F.sqrt(F.pow((F.col("lat2") - F.col("lat1")) * DEGREE_M, 2) + F.pow(F.col("turn") * DEGREE_M, 2))))
    left = cut(points.where(sound("lat", "lon") & F.col("id").isNotNull()).select(*spot).distinct().withColumns({"spot": F.struct(*spot), "scale": F.cos(F.radians("lat")) * DEGREE_M}))

    def met(left: DataFrame, reach_m: float) -> DataFrame:
        wide = 1.6 * reach_m  # half a piece and the reach, and how far the plane may be off
        pieces = usable.withColumn("n", F.greatest(F.ceil(F.col("long") / reach_m), F.lit(1)).cast("long"))
        pieces = pieces.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("middle", (F.col("k") + 0.5) / F.col("n"))
        pieces = pieces.withColumns({"mid_lat": F.col("lat1") + (F.col("lat2") - F.col("lat1")) * F.col("middle"), "on": F.col("turn") * F.col("middle")})
        pieces = with_cell(pieces.withColumn("mid_lon", F.col("lon1") + F.col("on")), "mid_lat", "mid_lon", wide)
        pieces = pieces.select("line", "lat1", "lat2", F.col("lon1"), "turn", "on", "_band", "_cell")
        both = with_cells_in_reach(left, "lat", "lon", wide).join(pieces, ["_band", "_cell"])
        away = F.col("lon1") - F.col("lon")
        away = F.when(F.abs("turn") <= 90.0, turned(away)).otherwise(turned(away + F.col("on")) - F.col("on"))  # on the piece's side of the globe
        both = both.select("spot", "line", (away * F.col("scale")).alias("x1"), ((away + F.col("turn")) * F.col("scale")).alias("x2"), *(((F.col(f"lat{k}") - F.col("lat")) * DEGREE_M).alias(f"y{k}") for k in (1, 2)), F.monotonically_increasing_id().alias("row"))
        length = F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2)
        t = F.when(length > 0, -(F.col("x1") * (F.col("x2") - F.col("x1")) + F.col("y1") * (F.col("y2") - F.col("y1"))) / length).otherwise(0.0)
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        metres = F.sqrt(F.pow(F.col("x1") + t * (F.col("x2") - F.col("x1")), 2) + F.pow(F.col("y1") + t * (F.col("y2") - F.col("y1")), 2))
        # `row` keeps the filter above the columns it is made of: inside the join they would be worked out again at each use
        best = both.select("spot", "line", "row", metres.alias("metres")).where((F.col("metres") <= reach_m) & (F.col("row") >= 0)).groupBy("spot").agg(F.min(F.struct("metres", "line")).alias("best"))
        return cut(best)

    found = None
    for k in range(finer, -1, -1):
        best = met(left, gate_m / 4**k)
        found = best if found is None else found.unionByName(best)
        left = left.join(best.select("spot"), "spot", "left_anti")
    found = points.select("id", *spot).join(found.select("spot.*", "best"), spot).groupBy("id").agg(F.min("best").alias("best"))
    return points.select("id").join(found.select("id", "best.line", "best.metres"), "id", "left")


def early_seeds(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id): seeds that the pass of `first_seeds` makes of `nodes` (id, ready), as far as their links (id, other; both ways)
    tell. A node that is not ready never becomes one.

    In rounds: a ready node before all its undecided neighbours is a seed; its neighbours are decided."""
    open_, left, seeds = cut(nodes.select("id", "ready")), links, None
    while True:
        first = left.groupBy("id").agg(F.min("other").alias("least"))
        now = cut(open_.join(first, "id", "left").where(F.col("ready") & (F.col("least").isNull() | (F.col("id") < F.col("least")))).select("id"))
        if now.isEmpty():
            return now if seeds is None else seeds
        seeds = now if seeds is None else seeds.union(now)
        gone = cut(now.union(left.join(now, "id", "left_semi").select("other")).distinct())
        open_ = cut(open_.join(gone, "id", "left_anti"))
        left = cut(left.join(gone, "id", "left_anti").join(gone.select(F.col("id").alias("other")), "other", "left_anti").select("id", "other"))


def first_seeds(spots: DataFrame, reach_m: float, crowd: int = 8) -> DataFrame:
    """(id, kind, lat, lon) of the seeds of a pass in the order of ids that makes each spot a seed unless an earlier seed
    of its kind is in reach.

    The `crowd` first of each kind in each cell are compared; one of them may be a seed if no cell in reach has a later
    one left out that comes before it. What new seeds reach is decided, and the next of each cell come up: what meets grows with
    cells, not with the square of what they hold."""
    columns = ["id", "kind", "lat", "lon"]
    open_, seeds = cut(spots.select(*columns)), None
    while not open_.isEmpty():
        first = Window.partitionBy("kind", "_band", "_cell").orderBy("id")
        some = with_cell(open_, "lat", "lon", reach_m).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= crowd)
        some = cut(some)
        last = some.where(F.col("_n") == crowd).select("kind", "_band", "_cell", F.col("id").alias("last"))  # others of the cell come later
        bar = with_cells_in_reach(some.select(*columns), "lat", "lon", reach_m).join(last, ["kind", "_band", "_cell"]).groupBy("id").agg(F.min("last").alias("bar"))
        nodes = some.select("id").join(bar, "id", "left").select("id", (F.col("bar").isNull() | (F.col("id") <= F.col("bar"))).alias("ready"))
        links = cut(within(some, some, reach_m, "kind").where("id <> other").select("id", "other"))
        now = cut(some.select(*columns).join(early_seeds(nodes, links), "id", "left_semi"))
        seeds = now if seeds is None else seeds.union(now)
        open_ = cut(open_.join(within(now, open_, reach_m, "kind").select(F.col("other").alias("id")), "id", "left_anti"))
    return spots.select(*columns).limit(0) if seeds is None else cut(seeds)


def consensus(elements: DataFrame, radius_m: float) -> DataFrame:
    """(seed, kind, n, best, conf) of elements (id, kind, lat, lon, conf): each takes those of its kind within the radius
    that no earlier one took; `best` is the most confident, and agreement raises the mean confidence by a tenth for
    each further element, up to 0.99. A missing confidence is 0.5. Ids order and are unique. Elements of one kind at one
    spot fare as the first of them."""
    elements = elements.withColumn("conf", F.coalesce("conf", F.lit(0.5)))
    place = ["kind", "lat", "lon"]
    spots = cut(elements.where(sound("lat", "lon") & F.col("kind").isNotNull() & F.col("id").isNotNull()).groupBy(*place).agg(F.min("id").alias("id")))
    near = within(first_seeds(spots, radius_m), spots, radius_m, "kind").groupBy("other").agg(F.min("id").alias("seed"))
    near = near.join(spots.withColumnRenamed("id", "other"), "other").select("seed", *place)
    taken = elements.select("id", *place, "conf").join(near, place, "left").withColumn("seed", F.coalesce("seed", "id"))  # alone without a place or kind
    n, digits = F.count(F.lit(1)), F.col("conf").try_cast("decimal(38,20)")  # sums of digits don't hang on the order
    mean = F.when(F.count(digits) == n, F.sum(digits).cast("double") / n).otherwise(F.avg("conf"))
    return taken.groupBy("seed", "kind").agg(n.alias("n"), F.max_by("id", F.struct("conf", -F.col("id"))).alias("best"), F.least(F.lit(0.99), mean * ((n + 9) / 10)).alias("conf"))


# Well-known text


def wkt_points(text: Column) -> Column:
    """The points (structs x, y) of a POINT, LINESTRING or POLYGON (its outer ring); null for what is none of them."""
    body = F.regexp_extract(text, r"(?i)^\s*(?:SRID=\d+;)?\s*(?:POINT|LINESTRING|POLYGON)\s*(?:Z|M|ZM)?\s*\(\s*\(?([^()]+)\)", 1)
    pair = lambda p: F.split(F.trim(p), r"\s+")
    return F.when(body != "", F.transform(F.split(body, ","), lambda p: F.struct(F.try_element_at(pair(p), F.lit(1)).try_cast("double").alias("x"), F.try_element_at(pair(p), F.lit(2)).try_cast("double").alias("y"))))


def wkt_centroid(text: Column) -> Column:
    """Struct x, y: a point itself, a line's middle of mass by length, a polygon's by area (its ring's, without one)."""
    p = wkt_points(text)
    n = F.size(p)
    steps = F.when(n > 1, F.zip_with(F.slice(p, 1, n - 1), F.slice(p, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))

    def mean(weight, x, y) -> Column:
        rows = F.transform(steps, lambda s: F.struct(weight(s).alias("w"), x(s).alias("x"), y(s).alias("y")))
        zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
        total = F.aggregate(rows, zero, lambda t, r: F.struct((t["w"] + r["w"]).alias("w"), (t["x"] + r["w"] * r["x"]).alias("x"), (t["y"] + r["w"] * r["y"]).alias("y")))
        return F.when(total["w"] != 0, F.struct((total["x"] / total["w"]).alias("x"), (total["y"] / total["w"]).alias("y")))

    cross = lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]
    length = lambda s: F.sqrt(F.pow(s["a"]["x"] - s["b"]["x"], 2) + F.pow(s["a"]["y"] - s["b"]["y"], 2))
    by_area = mean(cross, lambda s: (s["a"]["x"] + s["b"]["x"]) / 3, lambda s: (s["a"]["y"] + s["b"]["y"]) / 3)
    by_length = mean(length, lambda s: (s["a"]["x"] + s["b"]["x"]) / 2, lambda s: (s["a"]["y"] + s["b"]["y"]) / 2)
    area = F.upper(text).contains("POLYGON")
    return F.when(n >= 1, F.coalesce(F.when(area, by_area), F.when(n > 1, by_length), p[0]))


def previous_spots(df: DataFrame, key: str, t: str) -> DataFrame:
    """Adds `metres` since the row before of the same key, null at the first."""
    w = Window.partitionBy(key).orderBy(t)
    return df.withColumn("metres", haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")))
