"""Grid joins: boxes that may be near each other meet in cells, by an equi-join; the exact test stands beside it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import DEGREE, EARTH, distance


def with_cells(df: DataFrame, box: Column, cell: float, margin: float = 0.0, dx: Column | None = None) -> DataFrame:
    """``df`` once for each grid cell (cx, cy) that the box, grown by ``margin`` degrees (``dx`` along the longitude), touches."""
    gx = dx if dx is not None else F.lit(margin)
    span = lambda lo, hi, g, width: F.sequence(F.floor((lo - g) / width), F.floor((hi + g) / width))
    rows = df.withColumn("cy", F.explode(span(box["y1"], box["y2"], F.lit(margin), cell)))
    return rows.withColumn("cx", F.explode(span(box["x1"], box["x2"], gx, _row_width(F.col("cy"), cell))))


def _row_width(row: Column, cell: float) -> Column:
    """Degrees of longitude of the cells of a row: ``cell``, doubled as often as degrees shrink by half towards a pole, two turns at most."""
    far = F.least(F.greatest(F.abs(row * cell), F.abs((row + 1) * cell)), F.lit(90.0))
    return F.least(cell * F.pow(F.lit(2.0), F.floor(F.log2(1 / F.greatest(F.cos(F.radians(far)), F.lit(1e-12))))), F.lit(720.0))


def own_margin(box: Column, metres: float) -> Column:
    """``metres`` in degrees of longitude at the box's farthest latitude and as far again; a degree has a metre at least."""
    far = F.least(F.greatest(F.abs(box["y1"]), F.abs(box["y2"])) + metres / DEGREE, F.lit(90.0))
    return metres / F.greatest(DEGREE * F.cos(F.radians(far)), F.lit(1.0))


def box_join(left: DataFrame, right: DataFrame, metres: float, cell: float, on: Sequence[str] = ()) -> DataFrame:
    """Pairs of rows, equal in the columns ``on``, whose boxes (lbox and rbox) may be within ``metres``, each pair once.

    Each side is grown along the longitude by the margin of its own latitude, so that of the box farther from the
    equator counts; that is a superset, so an exact test must follow. A pair comes out only in the cell of the lower
    left corner of the overlap, which needs no distinct.
    """
    dy = metres / DEGREE
    lx, rx = own_margin(F.col("lbox"), metres), own_margin(F.col("rbox"), metres)
    a = with_cells(left, F.col("lbox"), cell, dy, lx)
    b = with_cells(right, F.col("rbox"), cell, dx=rx)
    first_y = F.floor(F.greatest(F.col("lbox.y1") - dy, F.col("rbox.y1")) / cell)
    first_x = F.floor(F.greatest(F.col("lbox.x1") - lx, F.col("rbox.x1") - rx) / _row_width(first_y, cell))
    return a.join(b, [*on, "cx", "cy"]).where((F.col("cx") == first_x) & (F.col("cy") == first_y)).drop("cx", "cy")


def _least_cos(lo: Column, hi: Column) -> Column:
    """The least size of the cosine between two latitudes, at most 180 degrees apart; 0 where a pole is between them."""
    pole = F.floor((lo + 90) / 180) != F.floor((hi + 90) / 180)
    return F.when(pole, F.lit(0.0)).otherwise(F.least(F.abs(F.cos(F.radians(lo))), F.abs(F.cos(F.radians(hi)))))


def _width(row: Column, cell: float) -> Column:
    """Degrees of longitude of a row's cells: about as wide as the row is high, and two turns at most."""
    return F.least(cell / F.greatest(_least_cos(row * cell, (row + 1) * cell), F.lit(1e-12)), F.lit(720.0))


def _east(c: str) -> Column:
    return F.pmod(F.col(c) + 180, F.lit(360.0))


def _reach(metres: Column) -> Column:
    return F.degrees(metres / EARTH) * (1 + 1e-9) + 1e-12


def onward_cells(places: DataFrame, metres: Column, cell: float) -> DataFrame:
    """``places`` once for their ``own`` cell (cx, cy) and each later one that may hold a place within ``metres``: a bounded number at any latitude."""
    dy = _reach(metres)
    slope = F.sin(metres / (2 * EARTH)) / F.greatest(_least_cos(F.col("lat") - dy, F.col("lat") + dy), F.lit(1e-12))
    dx = F.degrees(2 * F.asin(F.least(slope, F.lit(1.0)))) * (1 + 1e-9) + 1e-12
    row = F.floor(F.col("lat") / cell)
    a = places.withColumn("cy", F.explode(F.sequence(row, F.floor((F.col("lat") + dy) / cell))))
    a = a.withColumns({"_w": _width(F.col("cy"), cell), "_lo": _east("lon") - dx, "_hi": _east("lon") + dx})
    span = lambda lo, hi: F.sequence(F.floor(lo / F.col("_w")), F.floor(hi / F.col("_w")))
    inside = span(F.greatest("_lo", F.lit(0.0)), F.least("_hi", F.lit(360.0)))
    over = [F.when(F.col("_lo") < 0, span(F.col("_lo") + 360, F.lit(360.0))).otherwise(inside), F.when(F.col("_hi") > 360, span(F.lit(0.0), F.col("_hi") - 360)).otherwise(inside)]
    cells = F.when((F.col("_lo") < 0) | (F.col("_hi") > 360), F.array_distinct(F.concat(inside, *over))).otherwise(inside)  # over the date line too
    own = F.floor(_east("lon") / F.col("_w"))
    a = a.withColumn("cx", F.explode(cells)).where((F.col("cy") > row) | (F.col("cx") >= own))
    return a.withColumn("own", (F.col("cy") == row) & (F.col("cx") == own)).drop("_w", "_lo", "_hi")


def place_pairs(places: DataFrame, metres: Column, cell: float, on: Sequence[str] = ()) -> DataFrame:
    """Pairs of different places (id, lon, lat) within ``metres``, equal in the columns ``on``, each in one order: columns l_... and r_...

    A place stands in one cell and looks into those that come after it. Places about a pole and on both sides of the
    date line meet. Latitudes beyond a pole count as given: those farther apart than ``metres`` don't meet.
    """
    named = lambda d, s: d.withColumnsRenamed({c: f"{s}_{c}" for c in places.columns if c not in on})
    a = named(onward_cells(places, metres, cell), "l")
    b = named(places.withColumn("cy", F.floor(F.col("lat") / cell)).withColumn("cx", F.floor(_east("lon") / _width(F.col("cy"), cell))), "r")
    p = lambda s: F.struct(F.col(f"{s}_lon").alias("lon"), F.col(f"{s}_lat").alias("lat"))
    met = a.join(b, [*on, "cx", "cy"]).where((F.abs(F.col("l_lat") - F.col("r_lat")) <= _reach(metres)) & (~F.col("own") | (F.col("l_id") < F.col("r_id"))))
    return met.where(distance(p("l"), p("r")) <= metres).drop("cx", "cy", "own")
