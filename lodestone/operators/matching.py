"""Matching: segments are sampled, samples measured against the trusted trace, and the evidence is classified."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import boxes_near, distance, interpolate, line_length, point
from ..functions.keys import MATCH_VERSION, SEGMENT_VERSION, match_key
from ..functions.numbers import round_half_up
from .graph import checkpoint
from .nearest import measured
from .spatial import box_join
from .traces import gap_stats


@dataclass(frozen=True)
class MatchConfig:
    """Fixed values, in metres but for ratios."""

    search_radius: float = 35.0
    sample_interval: float = 20.0
    point_tolerance: float = 25.0
    endpoint_tolerance: float = 35.0
    minimum_coverage: float = 0.55
    strong_coverage: float = 0.9
    strong_median: float = 8.0
    strong_p95: float = 18.0
    maximum_median: float = 18.0
    maximum_p95: float = 35.0
    gap_ratio: float = 0.2
    longest_edge: float = 120.0
    candidate_gap_ratio: float = 0.45
    review_coverage: float = 0.35


def activity_boxes(points: DataFrame) -> DataFrame:
    """activity_key, lbox. An activity without points has no row and so no pair."""
    return points.groupBy("activity_key").agg(F.struct(F.min("lon").alias("x1"), F.min("lat").alias("y1"), F.max("lon").alias("x2"), F.max("lat").alias("y2")).alias("lbox"))


def segment_boxes(segments: DataFrame) -> DataFrame:
    xs, ys = F.transform("line", lambda p: p["lon"]), F.transform("line", lambda p: p["lat"])
    return segments.select("segment_key", F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2")).alias("rbox"))


def pairs(points: DataFrame, segments: DataFrame, config: MatchConfig = MatchConfig(), cell: float = 0.02) -> DataFrame:
    """activity_key, segment_key of boxes within the search radius: a grid join, then the exact test."""
    met = box_join(activity_boxes(points), segment_boxes(segments), config.search_radius, cell)
    return met.where(boxes_near(F.col("lbox"), F.col("rbox"), config.search_radius)).select("activity_key", "segment_key")


def samples(segments: DataFrame, interval: float = 20.0) -> DataFrame:
    """segment_key, sample_idx, place, is_end: the start, every multiple of ``interval`` short of the length, and the end.

    Each measure is placed on its edge by joining the edges' measure ranges inside the segment; a sample within
    0.01 m of the one before it goes. A line of no length gives its two ends, a line of one point nothing.
    """
    s = segments.where(F.size("line") >= 2).select("segment_key", "line")
    n = F.size("line")
    e = s.select("segment_key", F.posexplode(F.arrays_zip(F.slice("line", F.lit(1), n - 1).alias("a"), F.slice("line", F.lit(2), n - 1).alias("b"))).alias("i", "e")).select("segment_key", "i", "e.a", "e.b").withColumn("leg", distance(F.col("a"), F.col("b")))
    w = Window.partitionBy("segment_key").orderBy("i")
    e = e.withColumn("after", F.sum("leg").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.coalesce(F.lag("after").over(w), F.lit(0.0))).withColumn("total", F.max("after").over(Window.partitionBy("segment_key")))
    # a multiple lies on the first edge that ends at it or beyond: the edge itself can tell which ones
    first = F.when(F.col("i") == 0, F.lit(1)).otherwise(F.floor(F.col("before") / interval) + 1)
    last = F.when(F.col("after") >= F.col("total"), F.ceil(F.col("total") / interval) - 1).otherwise(F.floor(F.col("after") / interval))
    inner = e.where(first <= last).select("segment_key", "a", "b", "leg", "before", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("k"))
    inner = inner.select("segment_key", "k", interpolate(F.col("a"), F.col("b"), F.when(F.col("leg") == 0, F.lit(0.0)).otherwise((F.col("k") * interval - F.col("before")) / F.col("leg"))).alias("place"))
    ends = s.select("segment_key", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("k"), F.col("line")[0].alias("place")), F.struct(F.lit(1 << 60).alias("k"), F.element_at("line", -1).alias("place")))).alias("x")).select("segment_key", "x.k", "x.place")
    both = inner.unionByName(ends)
    v = Window.partitionBy("segment_key").orderBy("k")
    both = both.withColumn("_b", F.lag("place").over(v)).where(F.col("_b").isNull() | (distance(F.col("_b"), F.col("place")) > 0.01))
    return both.withColumn("sample_idx", F.row_number().over(v) - 1).select("segment_key", "sample_idx", "place")


def metrics(g: DataFrame, keys: list[str], config: MatchConfig = MatchConfig()) -> DataFrame:
    """Metrics of each row from its array ``d`` of distances in the samples' order: order statistics and runs of a batch of rows at once, in the task."""
    g = g.select(*keys, "d")
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = _figures(b.column(n).flatten().to_numpy(), b.column(n).value_lengths().to_numpy().astype(np.int64), config.point_tolerance)
                yield pa.RecordBatch.from_arrays([*b.columns[:n], *map(pa.array, got.values())], [*keys, *got])

    shape = g.select(*keys).schema
    for c in ("samples", "covered", "longest_run"):
        shape = shape.add(c, "long")
    for c in ("low", "high", "p95", "most", "start_distance", "end_distance"):
        shape = shape.add(c, "double")
    m = g.mapInArrow(run, shape)
    return m.select(
        *keys,
        "samples",
        "covered",
        round_half_up(F.col("covered") / F.col("samples"), 4).alias("coverage"),
        round_half_up((F.col("low") + F.col("high")) / 2, 3).alias("median_distance"),
        round_half_up(F.col("p95"), 3).alias("p95_distance"),
        round_half_up(F.col("most"), 3).alias("max_distance"),
        "start_distance",
        "end_distance",
        "longest_run",
        round_half_up(F.col("longest_run") / F.col("samples"), 4).alias("gap_ratio"),
    )


def _figures(d: np.ndarray, samples: np.ndarray, tolerance: float) -> dict[str, np.ndarray]:
    """Of rows of so many distances each, which follow each other in ``d`` (none is empty)."""
    end = np.cumsum(samples)
    at, row, idx = end - samples, np.repeat(np.arange(len(samples)), samples), np.arange(len(d))
    far, ranked = d > tolerance, d[np.lexsort((d, row))]
    half = (samples + 1) // 2
    run = idx - np.maximum(np.maximum.accumulate(np.where(far, -1, idx)), at[row] - 1)
    return {
        "samples": samples,
        "covered": np.add.reduceat(~far, at, dtype=np.int64),
        "longest_run": np.maximum.reduceat(run, at),
        "low": ranked[at + half - 1],
        "high": ranked[end - half],
        "p95": ranked[at + np.maximum(1, np.ceil(samples * 0.95)).astype(np.int64) - 1],
        "most": ranked[end - 1],
        "start_distance": d[at],
        "end_distance": d[end - 1],
    }


def is_strong(config: MatchConfig, p: str = "") -> Column:
    c = lambda n: F.col(f"{p}{n}")
    return (c("coverage") >= config.strong_coverage) & (c("start_distance") <= config.endpoint_tolerance) & (c("end_distance") <= config.endpoint_tolerance) & (c("median_distance") <= config.strong_median) & (c("p95_distance") <= config.strong_p95) & (c("gap_ratio") <= config.gap_ratio)


def classification(config: MatchConfig) -> Column:
    reached = F.least("start_distance", "end_distance") <= config.endpoint_tolerance
    middle = (F.col("coverage") >= config.minimum_coverage) & (F.col("median_distance") <= config.point_tolerance)
    return (
        F.when(is_strong(config) & F.col("strong_component").isNotNull(), "strong_candidate")
        .when((F.col("coverage") >= config.strong_coverage) & reached, "needs_review")
        .when(middle & (F.col("blocked") | (F.col("ignored_edges") > 0)), "needs_review")
        .when(middle & ((F.col("median_distance") > config.maximum_median) | (F.col("p95_distance") > config.maximum_p95)), "needs_review")
        .when(middle & reached & (F.col("gap_ratio") <= config.candidate_gap_ratio), "candidate")
        .when(middle, "needs_review")
        .when((F.col("coverage") >= config.review_coverage) | (F.col("median_distance") <= config.point_tolerance), "needs_review")
        .otherwise("insufficient_coverage")
    )


def found(points: DataFrame, segments: DataFrame, config: MatchConfig = MatchConfig(), pair: DataFrame | None = None) -> DataFrame:
    """Rows of ``measured``, written once as several branches read them."""
    pair = pairs(points, segments, config) if pair is None else pair
    return checkpoint(measured(pair, samples(segments, config.sample_interval), points, config.point_tolerance, config.longest_edge))


def least(near: DataFrame) -> DataFrame:
    """activity_key, segment_key, i, distance: of each sample the smallest distance of all rows of its pair."""
    one = near.select("activity_key", "segment_key", F.explode(F.arrays_zip("i", "least")).alias("x"))
    return one.groupBy("activity_key", "segment_key", "x.i").agg((F.min("x.least") / 1000.0).alias("distance"))


def component_evidence(points: DataFrame, segments: DataFrame, config: MatchConfig = MatchConfig(), pair: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(evidence by pair and component, evidence by pair): coverage, endpoint distances, median, p95, largest, gap ratio.

    Distances are found once by component; those of the pair are the smallest of its components.
    """
    near = found(points, segments, config, pair)
    both, metres = ["activity_key", "segment_key"], lambda c: F.transform(c, lambda x: x / 1000.0)
    one = near.select(*both, "block", "blocks", F.explode(F.arrays_zip("component_idx", "mm")).alias("c")).select(*both, "block", "blocks", "c.component_idx", "c.mm")
    # only segments of several blocks need their rows put together
    key = [*both, "component_idx"]
    pieces = one.where("blocks > 1").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("block", "mm"))).alias("x")).select(*key, F.flatten("x.mm").alias("mm"))
    by_component = metrics(one.where("blocks = 1").select(*key, "mm").unionByName(pieces).select(*key, metres("mm").alias("d")), key, config)
    at = lambda c: F.when(c.isNotNull(), point(c["lon"], c["lat"]))
    shared = near.where("not alone")
    lines = least(shared).groupBy(*both).agg(F.sort_array(F.collect_list(F.struct("i", "distance"))).alias("x")).select(*both, F.col("x.distance").alias("d"))
    lines = lines.join(shared.groupBy(*both).agg(at(F.min("first")).alias("first_matched"), at(F.min("last")).alias("last_matched")), both)
    whole = near.where("alone").select(*both, metres("least").alias("d"), at(F.col("first")).alias("first_matched"), at(F.col("last")).alias("last_matched"))
    by_pair = metrics(whole.unionByName(lines), [*both, "first_matched", "last_matched"], config)
    return by_component, by_pair


def match(points: DataFrame, segments: DataFrame, config: MatchConfig = MatchConfig(), pair: DataFrame | None = None) -> DataFrame:
    """One classified row per activity and segment whose boxes are near, or of those of ``pair``, with the evidence.

    Points are (activity_key, component_idx, point_idx, lon, lat), segments (segment_key, line).
    """
    by_component, by_pair = component_evidence(points, segments, config, pair)
    c = by_component.withColumn("strong", is_strong(config))
    both_ends = (F.col("start_distance") <= config.endpoint_tolerance) & (F.col("end_distance") <= config.endpoint_tolerance)
    comp = c.groupBy("activity_key", "segment_key").agg(
        F.max("coverage").alias("best_coverage"),
        F.max_by("component_idx", F.struct("coverage", -F.col("component_idx"))).alias("best_component"),
        F.min(F.when(F.col("strong"), F.col("component_idx"))).alias("strong_component"),
        F.max(both_ends).alias("one_reaches_both"),
    )
    full = by_pair.join(comp, ["activity_key", "segment_key"]).join(gap_stats(points, config.longest_edge), "activity_key")
    lengths = segments.select("segment_key", round_half_up(line_length(F.col("line")), 3).alias("segment_metres"))
    full = full.join(lengths, "segment_key").withColumn("blocked", is_strong(config) & F.col("strong_component").isNull())
    return full.withColumn("classification", classification(config)).withColumn("match_key", match_key(F.col("activity_key"), F.col("segment_key")))


def diagnostics(matches: DataFrame, points: DataFrame, segments: DataFrame) -> DataFrame:
    """One row: pairs considered, rejected by box and scored, by class, and what has no potential evidence."""
    potential = F.col("classification") != "insufficient_coverage"
    n = matches.agg(
        F.count("*").alias("scored"),
        *[F.count_if(F.col("classification") == c).alias(c) for c in ("strong_candidate", "candidate", "needs_review", "insufficient_coverage")],
        F.count_distinct(F.when(potential, F.col("activity_key"))).alias("matched_activities"),
        F.count_distinct(F.when(potential, F.col("segment_key"))).alias("matched_segments"),
    )
    a, s = points.agg(F.count_distinct("activity_key").alias("activities")), segments.agg(F.count_distinct("segment_key").alias("segments"))
    return n.join(F.broadcast(a)).join(F.broadcast(s)).withColumn("considered", F.col("activities") * F.col("segments")).withColumn("box_rejected", F.col("considered") - F.col("scored")).withColumn("unmatched_activities", F.col("activities") - F.col("matched_activities"))


def unmatched(points: DataFrame, matches: DataFrame) -> DataFrame:
    """Activities without potential evidence."""
    some = matches.where("classification <> 'insufficient_coverage'").select("activity_key").distinct()
    return points.select("activity_key").distinct().join(some, "activity_key", "left_anti")


def artifact_issues(matches: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """Checks of a finished table of matches: keys, finite and sane metrics, and a classification that follows from them."""
    from .issues import duplicates, every, issues

    about = lambda t: F.concat(F.lit(f"{t}:"), F.col("match_key"))
    numbers = ("coverage", "start_distance", "end_distance", "median_distance", "p95_distance", "max_distance", "gap_ratio", "segment_metres", "raw_metres", "trusted_metres", "max_gap", "p95_gap")
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c)) | (F.abs(F.col(c)) == float("inf"))
    rules = [(f"non_finite_{c}", bad(c), about(f"non-finite {c}")) for c in numbers]
    rules += [(f"outside_{c}", ~F.col(c).between(0, 1), about(f"{c} outside 0..1")) for c in ("coverage", "gap_ratio", "best_coverage")]
    rules += [(f"negative_{c}", F.col(c) < 0, about(f"negative {c}")) for c in ("start_distance", "end_distance", "median_distance", "p95_distance", "max_distance")]
    rules += [
        ("unstable_key", ~F.col("match_key").eqNullSafe(match_key(F.col("activity_key"), F.col("segment_key"))), about("unstable key")),
        ("classification", ~F.col("classification").eqNullSafe(classification(config)), about("classification is not deterministic")),
        ("strong_below_thresholds", (F.col("classification") == "strong_candidate") & ~(is_strong(config) & F.col("strong_component").isNotNull()), about("strong below thresholds")),
    ]
    return every(issues(matches, rules), duplicates(matches, ["activity_key", "segment_key"], "duplicate_pair"))


def reference_issues(matches: DataFrame, activities: DataFrame, segments: DataFrame, version: str | None = None) -> DataFrame:
    """Checks of matches against what they refer to, and of the approval of the segments.

    Activities are (activity_key); segments are (segment_key, segment_decision, start_decision, end_decision,
    construction_version); ``version`` is that of the table of matches. A decision that isn't there counts as not accepted.
    """
    from .issues import dealt, duplicates, every, issues, unknown

    about = lambda rule: F.concat(F.lit(f"{rule}:"), F.coalesce("segment_key", F.lit("")))
    lacks = lambda c, rule: (rule, ~F.col(c).eqNullSafe(F.lit("accepted")), about(rule))
    approval = [
        lacks("segment_decision", "segment_not_accepted"),
        lacks("start_decision", "start_junction_not_accepted"),
        lacks("end_decision", "end_junction_not_accepted"),
        ("construction_version", ~F.col("construction_version").eqNullSafe(F.lit(SEGMENT_VERSION)), about("construction_version")),
    ]
    stale = matches.sparkSession.range(1).where(~F.lit(version).eqNullSafe(F.lit(MATCH_VERSION))).select(F.lit("match_version").alias("rule"), F.lit("match_version").alias("message"))
    of_activity, of_segment, of_pair = dealt(matches, ["activity_key"], ["segment_key"], ["activity_key", "segment_key"])
    (activities,), (segments,) = dealt(activities, ["activity_key"]), dealt(segments, ["segment_key"])
    return every(
        issues(segments, approval),
        duplicates(activities, ["activity_key"], "duplicate_activity"),
        duplicates(segments, ["segment_key"], "duplicate_segment"),
        unknown(of_activity, activities, ["activity_key"], "unknown_activity"),
        unknown(of_segment, segments, ["segment_key"], "unknown_segment"),
        duplicates(of_pair, ["activity_key", "segment_key"], "duplicate_pair"),
        stale,
    )
