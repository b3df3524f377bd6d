"""Histories: validity intervals from a log of states, as-of joins, times of last change, completed segments of users.

A key's log is cut by time into slices (a day by default). Windows run inside a slice, and what passes from one slice
to the next is one row per key and slice, so a key that holds a third of the log isn't sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .decisions import latest


def intervals(log: DataFrame, keys: Sequence[str], at: str, state: str, order: Sequence[str] = (), unit: str = "day") -> DataFrame:
    """keys, state, valid_from, valid_to of every run of one state; valid_to is the next run's start, null for the last.

    Of rows with one key and time the last by ``order`` counts. Rows without a time go; a null state is a state.
    """
    slice_ = F.date_trunc(unit, F.col(at)).alias("_slice")
    rows = latest(log.where(F.col(at).isNotNull()).select(*dict.fromkeys([*keys, at, state, *order])), [*keys, at], order or [state])
    rows = rows.select(*keys, slice_, F.col(at).alias("valid_from"), F.col(state).alias("_state"))
    inside, across = Window.partitionBy(*keys, "_slice").orderBy("valid_from"), Window.partitionBy(*keys).orderBy("_slice")
    box = F.struct(F.col("_state").alias("s"))
    before = rows.groupBy(*keys, "_slice").agg(F.max_by(box, "valid_from").alias("_last")).withColumn("_before", F.lag("_last").over(across)).drop("_last")
    seen = rows.join(before, [*keys, "_slice"]).withColumn("_previous", F.coalesce(F.lag(box).over(inside), F.col("_before")))
    runs = seen.where(F.col("_previous").isNull() | ~F.col("_previous.s").eqNullSafe(F.col("_state"))).drop("_before", "_previous")
    after = runs.groupBy(*keys, "_slice").agg(F.min("valid_from").alias("_first")).withColumn("_after", F.lead("_first").over(across)).drop("_first")
    out = runs.join(after, [*keys, "_slice"]).withColumn("valid_to", F.coalesce(F.lead("valid_from").over(inside), F.col("_after")))
    return out.select(*keys, F.col("_state").alias(state), "valid_from", "valid_to")


def as_of(left: DataFrame, log: DataFrame, keys: Sequence[str], at: str, state: str, order: Sequence[str] = (), unit: str = "day") -> DataFrame:
    """``left`` with ``state`` of the last row of ``log`` of its key at its own time or before; null if there is none.

    ``left`` keeps all its rows, those without key or time too. ``log`` has the keys, the time under the same name, and
    the state; of its rows with one key and time the last by ``order`` counts.
    """
    if state in left.columns:
        raise ValueError(f"{state} is a column of the left side")
    columns = left.columns
    slice_ = F.date_trunc(unit, F.col(at))
    timed = F.col(at).isNotNull()
    for k in keys:
        timed = timed & F.col(k).isNotNull()
    states = latest(log.where(timed).select(*dict.fromkeys([*keys, at, state, *order])), [*keys, at], order or [state])
    states = states.select(*keys, at, slice_.alias("_slice"), F.struct(F.col(state).alias("s")).alias("_state"))
    rows = left.where(timed).select(*keys, at, slice_.alias("_slice"), F.struct(*columns).alias("_row"))
    kept = states.groupBy(*keys, "_slice").agg(F.max_by("_state", at).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = kept.unionByName(rows.select(*keys, "_slice").distinct(), allowMissingColumns=True).groupBy(*keys, "_slice").agg(F.first("_last", ignorenulls=True).alias("_last"))
    carried = carried.withColumn("_carried", F.last("_last", ignorenulls=True).over(across)).drop("_last")
    inside = Window.partitionBy(*keys, "_slice").orderBy(at, F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = states.unionByName(rows, allowMissingColumns=True).withColumn("_inside", F.last("_state", ignorenulls=True).over(inside))
    met = both.where("_row is not null").join(carried, [*keys, "_slice"]).select("_row.*", F.coalesce("_inside", "_carried")["s"].alias(state))
    return met.unionByName(left.where(~F.coalesce(timed, F.lit(False))), allowMissingColumns=True).select(*columns, state)


def updated_at(keys: Sequence[str], *changes: tuple[DataFrame, str]) -> DataFrame:
    """keys, updated_at: the last time at which any of the tables (rows, time column) changed a key; null if none has a time."""
    parts = [df.select(*keys, F.col(at).alias("updated_at")) for df, at in changes]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.max("updated_at").alias("updated_at"))


#: The ways in which a segment is completed, strongest first.
METHODS = ("admin", "manual", "gpx_match")


def completions(activities: DataFrame, matches: DataFrame, entered: DataFrame | None = None) -> DataFrame:
    """user_id, segment_key, activity_key, completed_on, completion_method, match_confidence: one row per user and segment.

    Activities are (activity_key, user_id, completed_on), accepted matches (activity_key, segment_key, match_confidence),
    entered ones (user_id, segment_key, completed_on, completion_method). The earliest completion stands (one without a
    date last), then the stronger method, the surer match, the smaller activity. Matches of unknown activities go, and so
    do rows without user or segment, and methods that aren't known.
    """
    columns = ["user_id", "segment_key", "activity_key", "completed_on", "completion_method", "match_confidence"]
    found = matches.join(activities, "activity_key").withColumn("completion_method", F.lit("gpx_match")).select(columns)
    if entered is not None:
        found = found.unionByName(entered.select("user_id", "segment_key", "completed_on", "completion_method"), allowMissingColumns=True)
    rank = F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.col("completion_method"))
    found = found.where(F.col("user_id").isNotNull() & F.col("segment_key").isNotNull() & (rank > 0))
    first = F.struct(F.col("completed_on").isNull(), "completed_on", rank, -F.col("match_confidence"), "activity_key")
    kept = found.groupBy("user_id", "segment_key").agg(F.min_by(F.struct(*columns[2:]), first).alias("c"))
    return kept.select("user_id", "segment_key", "c.*")
