"""Geometry on longitude and latitude as Column expressions: all inside code generation, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import round_half_up

#: Metres of the earth's radius, of a mile, and of a degree of latitude.
EARTH, MILE, DEGREE = 6371008.8, 1609.344, 111320.0

POINT = "struct<lon:double,lat:double>"
LINE = f"array<{POINT}>"


def point(lon: Column | float, lat: Column | float) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(as_col(lon).cast("double").alias("lon"), as_col(lat).cast("double").alias("lat"))


def distance(a: Column, b: Column) -> Column:
    """Haversine metres between two points."""
    dlat, dlon = F.radians(b["lat"] - a["lat"]), F.radians(b["lon"] - a["lon"])
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(a["lat"])) * F.cos(F.radians(b["lat"])) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def _plane(p: Column, lon: Column, lat: Column) -> tuple[Column, Column]:
    return (p["lon"] - lon) * DEGREE * F.cos(F.radians(lat)), (p["lat"] - lat) * DEGREE


def closest_on_edge(p: Column, a: Column, b: Column) -> Column:
    """struct(distance, ratio, lon, lat): the place on edge a-b nearest to p, in a plane about the mean of the three."""
    lon, lat = (p["lon"] + a["lon"] + b["lon"]) / 3, (p["lat"] + a["lat"] + b["lat"]) / 3
    (px, py), (ax, ay), (bx, by) = _plane(p, lon, lat), _plane(a, lon, lat), _plane(b, lon, lat)
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    ratio = F.when(square == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * dx + (py - ay) * dy) / square)))
    at = point((ax + dx * ratio) / (DEGREE * F.cos(F.radians(lat))) + lon, (ay + dy * ratio) / DEGREE + lat)
    return F.struct(distance(p, at).alias("distance"), ratio.alias("ratio"), at["lon"].alias("lon"), at["lat"].alias("lat"))


def interpolate(a: Column, b: Column, ratio: Column) -> Column:
    return point(a["lon"] + (b["lon"] - a["lon"]) * ratio, a["lat"] + (b["lat"] - a["lat"]) * ratio)


def crossing(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Where edge a meets edge b, as a point on a; null for parallel edges and where they don't meet."""
    lon = (a1["lon"] + a2["lon"] + b1["lon"] + b2["lon"]) / 4
    lat = (a1["lat"] + a2["lat"] + b1["lat"] + b2["lat"]) / 4
    (px, py), (p2x, p2y), (qx, qy), (q2x, q2y) = (_plane(v, lon, lat) for v in (a1, a2, b1, b2))
    rx, ry, sx, sy = p2x - px, p2y - py, q2x - qx, q2y - qy
    cross = rx * sy - ry * sx
    t = F.try_divide((qx - px) * sy - (qy - py) * sx, cross)
    u = F.try_divide((qx - px) * ry - (qy - py) * rx, cross)
    slack = 1e-9
    meets = (F.abs(cross) >= slack) & t.between(-slack, 1 + slack) & u.between(-slack, 1 + slack)
    return F.when(meets, interpolate(a1, a2, F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))))


def bbox(points: Column) -> Column:
    """struct(x1, y1, x2, y2) of an array of points; null of none."""
    xs, ys = F.transform(points, lambda p: p["lon"]), F.transform(points, lambda p: p["lat"])
    return F.when(F.size(points) > 0, F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2")))


def boxes_near(a: Column, b: Column, metres: float) -> Column:
    """Whether the boxes overlap once grown by ``metres``, longitudes at the latitude farthest from the equator."""
    far = F.greatest(*[F.abs(v) for v in (a["y1"], a["y2"], b["y1"], b["y2"])])
    dy = metres / DEGREE
    dx = metres / F.greatest(DEGREE * F.cos(far * (3.141592653589793 / 180)), F.lit(1.0))
    return ~((a["x2"] + dx < b["x1"]) | (a["x1"] - dx > b["x2"]) | (a["y2"] + dy < b["y1"]) | (a["y1"] - dy > b["y2"]))


def line_length(points: Column) -> Column:
    """Metres along an array of points; 0 below two."""
    n = F.size(points)
    legs = F.zip_with(F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))), distance)
    return F.when(n < 2, F.lit(0.0)).otherwise(F.aggregate(legs, F.lit(0.0), lambda acc, x: acc + x))


def miles(metres: Column) -> Column:
    return round_half_up(metres / MILE, 6)


def valid_point(p: Column) -> Column:
    ok = lambda v, most: v.isNotNull() & ~F.isnan(v) & v.between(-most, most)
    return F.coalesce(ok(p["lon"], 180.0) & ok(p["lat"], 90.0), F.lit(False))
