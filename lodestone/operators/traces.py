"""Traces: gaps between points, trusted lines, runs, measures and repeated points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import distance, point, valid_point
from ..functions.numbers import round_half_up

#: Fixed value: longest edge, in metres, that is believed between two points.
LONGEST_EDGE = 120.0


def _along(by: Sequence[str] = ("activity_key", "component_idx")) -> Window:
    return Window.partitionBy(*by).orderBy("point_idx")


def clean_points(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points of components with two valid ones or more, numbers of original and malformed points by activity)."""
    p = points.withColumn("ok", valid_point(point(F.col("lon"), F.col("lat"))))
    size = p.groupBy("activity_key", "component_idx").agg(F.count_if("ok").alias("valid"))
    p = p.join(size, ["activity_key", "component_idx"]).withColumn("kept", F.col("ok") & (F.col("valid") >= 2))
    counts = p.groupBy("activity_key").agg(F.count("*").alias("original_points"), F.count_if(~F.col("kept")).alias("malformed_points"))
    return p.where("kept").drop("ok", "valid", "kept"), counts


def edges(points: DataFrame) -> DataFrame:
    """activity_key, component_idx, point_idx, a, b, gap of consecutive points; b and gap are null at the end."""
    here = point(F.col("lon"), F.col("lat"))
    nxt = F.lead(here).over(_along())
    return points.withColumn("a", here).withColumn("b", nxt).withColumn("gap", F.when(F.col("b").isNotNull(), distance(F.col("a"), F.col("b"))))


def trusted_lines(points: DataFrame, longest: float = LONGEST_EDGE) -> DataFrame:
    """Points with line_idx: a gap over ``longest`` begins a new line; line_points tells how many the line has.

    Lines of one point are no line, but their point stays as evidence.
    """
    w = _along()
    gap = F.lag("gap").over(w)
    e = edges(points).withColumn("new", (F.coalesce(gap, F.lit(0.0)) > longest).cast("int"))
    e = e.withColumn("line_idx", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.withColumn("line_points", F.count("*").over(Window.partitionBy("activity_key", "component_idx", "line_idx"))).drop("new")


def trusted_edges(points: DataFrame, longest: float = LONGEST_EDGE) -> DataFrame:
    """Edges a-b of the trusted lines."""
    return trusted_lines(points, longest).where(F.col("gap") <= longest)


def gap_stats(points: DataFrame, longest: float = LONGEST_EDGE) -> DataFrame:
    """By activity: largest gap, nearest-rank 95th percentile, edges too long to believe, metres in all and trusted."""
    e = edges(points)
    return e.groupBy("activity_key").agg(
        round_half_up(F.coalesce(F.max("gap"), F.lit(0.0)), 3).alias("max_gap"),
        round_half_up(F.coalesce(F.expr("percentile_disc(0.95) within group (order by gap)"), F.lit(0.0)), 3).alias("p95_gap"),
        F.count_if(F.col("gap") > longest).alias("ignored_edges"),
        round_half_up(F.coalesce(F.sum("gap"), F.lit(0.0)), 3).alias("raw_metres"),
        round_half_up(F.coalesce(F.sum(F.when(F.col("gap") <= longest, F.col("gap"))), F.lit(0.0)), 3).alias("trusted_metres"),
    )


def activity_summary(points: DataFrame) -> DataFrame:
    """One row: activities, points, first and last start by text."""
    return points.agg(F.count_distinct("activity_key").alias("activities"), F.count("*").alias("points"), F.min("time").alias("earliest"), F.max("time").alias("latest"))


def measures(points: DataFrame) -> DataFrame:
    """Points with the metres from the start of their component."""
    w = _along()
    e = edges(points).withColumn("leg", F.coalesce(F.lag("gap").over(w), F.lit(0.0)))
    return e.withColumn("measure", F.sum("leg").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("leg")


def drop_repeated_points(points: DataFrame, least: float = 0.01) -> DataFrame:
    """Points that are over ``least`` metres from the point before them in the original order."""
    here = point(F.col("lon"), F.col("lat"))
    before = F.lag(here).over(_along())
    return points.withColumn("_b", before).where(F.col("_b").isNull() | (distance(F.col("_b"), here) > least)).drop("_b")


def longest_run(rows: DataFrame, keys: Sequence[str], order: str, flag: str) -> DataFrame:
    """By keys the longest run of consecutive rows whose flag is false; 0 if there is none."""
    w = Window.partitionBy(*keys).orderBy(order)
    v = Window.partitionBy(*keys, flag).orderBy(order)
    island = rows.withColumn("_i", F.row_number().over(w) - F.row_number().over(v))
    runs = island.where(~F.col(flag)).groupBy(*keys, "_i").count().groupBy(*keys).agg(F.max("count").alias("longest_run"))
    return rows.select(*keys).distinct().join(runs, list(keys), "left").withColumn("longest_run", F.coalesce("longest_run", F.lit(0)))
