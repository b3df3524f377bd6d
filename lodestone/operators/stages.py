"""Stages that do again only what changed: fingerprints per activity and segment tell which pairs to match anew."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import MATCH_VERSION, line_text
from .graph import checkpoint
from .matching import MatchConfig, match, pairs
from .versions import Versions

_PRINT = "print string"


def _row_sums(*columns: Column) -> Column:
    """A text over a group's rows in any order: their number and two sums of seeded hashes. Partial sums combine before the shuffle."""
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(20,0)")).cast("string")
    return F.sha2(F.concat_ws("|", F.count("*").cast("string"), total(1), total(2)), 256)


def activity_prints(points: DataFrame) -> DataFrame:
    """activity_key, print of all points of an activity with their places in it."""
    return points.groupBy("activity_key").agg(_row_sums("component_idx", "point_idx", "lon", "lat").alias("print"))


def segment_prints(segments: DataFrame) -> DataFrame:
    """segment_key, print of a segment's line."""
    return segments.select("segment_key", F.sha2(line_text(F.col("line"), 9), 256).alias("print"))


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, change of keys that were added, changed or removed."""
    both = new.select(key, F.col("print").alias("_new")).join(old.select(key, F.col("print").alias("_old")), key, "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def rematch(points: DataFrame, segments: DataFrame, matches: DataFrame, activity_changes: DataFrame, segment_changes: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """Matches of now from those of before: pairs of an activity or segment that changed are matched, the rest is kept.

    A match depends on its own activity and segment only, so the result is that of matching everything.
    """
    a, s = activity_changes.select("activity_key"), segment_changes.select("segment_key")
    kept = matches.join(a, "activity_key", "left_anti").join(s, "segment_key", "left_anti")
    near = pairs(points, segments, config).join(a.withColumn("_a", F.lit(True)), "activity_key", "left").join(s.withColumn("_s", F.lit(True)), "segment_key", "left")
    anew = near.where("_a or _s").select("activity_key", "segment_key")
    return kept.unionByName(match(points, segments, config, anew))


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


class MatchStage(Versions):
    """Matches below ``root`` with the fingerprints of what they come from, in versions."""

    def run(self, points: DataFrame, segments: DataFrame, generated_at: str, config: MatchConfig = MatchConfig()) -> dict[str, int]:
        """Bring the stage up to date; numbers of changed activities and segments.

        With other settings or another version of the rules everything is matched again. If nothing changed, nothing is
        written and the time of the standing version stays as ``generated_at``.
        """
        settings = "|".join([MATCH_VERSION, *[f"{k}={v}" for k, v in sorted(asdict(config).items())]])
        shape = match(points.limit(0), segments.limit(0), config)
        self.schemas = {"matches": _schema(shape), "activities": f"activity_key string, {_PRINT}", "segments": f"segment_key string, {_PRINT}", "run": "settings string, generated_at string"}
        number, version = self.version()
        stands = self.read("run", version).first()
        if stands is not None and stands.settings != settings:
            version = None
        a, s = checkpoint(activity_prints(points)), checkpoint(segment_prints(segments))
        changed_a, changed_s = checkpoint(changes(self.read("activities", version), a, "activity_key")), checkpoint(changes(self.read("segments", version), s, "segment_key"))
        n = {"activities": changed_a.count(), "segments": changed_s.count()}
        if version is not None and not any(n.values()):
            return n
        fresh = self.fresh(number + 1)
        matches = rematch(points, segments, self.read("matches", version), changed_a, changed_s, config)
        run = self.spark.createDataFrame([(settings, generated_at)], self.schemas["run"])
        self.write(fresh, {"matches": matches, "activities": a, "segments": s, "run": run.coalesce(1)})
        self.switch(number + 1, fresh)
        return n
