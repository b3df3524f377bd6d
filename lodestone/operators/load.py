"""Load of a publication run: planned against what is there, refused on conflict, switched in by one rename.

The tables are trails, segments and the ledger of runs.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import line_fingerprint
from .issues import assert_clean, duplicates, every, issues, unknown
from .versions import Versions

_RUN_COLUMNS = "publication_run_id string, publication_artifact_fingerprint string"
TRAILS = f"trail_key string, trail_id string, slug string, name string, region string, reviewed_at string, {_RUN_COLUMNS}"
SEGMENTS = f"production_key string, segment_id string, trail_key string, segment_name string, miles decimal(8,3), line array<struct<lon:double,lat:double>>, reviewed_at string, {_RUN_COLUMNS}"
RUNS = "publication_run_id string, artifact_fingerprint string, algorithm_version string, generated_at string, diagnostics string"
SCHEMAS = {"trails": TRAILS, "segments": SEGMENTS, "runs": RUNS}
#: What an existing row must agree in; lines in either direction are equal.
TRAIL_IDENTITY = ("slug", "name", "region")
SEGMENT_IDENTITY = ("trail_key", "segment_name", "line")


@dataclass(frozen=True)
class Run:
    """A publication run: its artifact's fingerprint, and what the ledger says of it."""

    fingerprint: str
    algorithm_version: str
    generated_at: str | None = None
    diagnostics: str = "{}"
    demo_only: bool = False


def _same(name: str, old: Column) -> Column:
    if name == "line":
        # lines that are equal as they are, in either direction, need no texts
        equal = F.col(name).eqNullSafe(old) | F.coalesce(F.col(name) == F.reverse(old), F.lit(False))
        return F.when(equal, True).otherwise(line_fingerprint(F.col(name)).eqNullSafe(line_fingerprint(old)))
    return F.col(name).eqNullSafe(old)


def plan(existing: DataFrame, incoming: DataFrame, key: str, identity: tuple[str, ...]) -> DataFrame:
    """key, action of incoming rows: insert, update, or refuse where an existing row differs in its identity."""
    old = existing.select(key, F.lit(True).alias("_known"), *[F.col(c).alias(f"_{c}") for c in identity])
    same = F.lit(True)
    for c in identity:
        same = same & _same(c, F.col(f"_{c}"))
    action = F.when(F.col("_known").isNull(), "insert").when(same, "update").otherwise("refuse")
    return incoming.join(old, key, "left").select(key, action.alias("action"))


def _blank(c: str) -> Column:
    return F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) == 0


def refusals(trails: DataFrame, segments: DataFrame, old_trails: DataFrame, old_segments: DataFrame) -> DataFrame:
    """rule, message of everything for which a load is refused."""
    refused = lambda df, key, rule: df.where("action = 'refuse'").select(F.lit(rule).alias("rule"), F.concat(F.lit(f"{rule}:"), F.col(key)).alias("message"))
    known = old_trails.select("trail_key").unionByName(trails.select("trail_key"))
    return every(
        issues(trails, [("trail_key_missing", _blank("trail_key"), F.lit("trail_key_missing"))]),
        issues(segments, [("segment_key_missing", _blank("production_key"), F.lit("segment_key_missing"))]),
        duplicates(trails, ["trail_key"], "trail_repeated"),
        duplicates(segments, ["production_key"], "segment_repeated"),
        unknown(segments, known, ["trail_key"], "trail_unknown"),
        refused(plan(old_trails, trails, "trail_key", TRAIL_IDENTITY), "trail_key", "trail_conflict"),
        refused(plan(old_segments, segments, "production_key", SEGMENT_IDENTITY), "production_key", "segment_conflict"),
    )


def merge(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows and the existing ones that they don't replace. Keys are unique on both sides."""
    return existing.join(incoming.select(key), key, "left_anti").unionByName(incoming)


class Publication(Versions):
    """Tables of published trails and segments, and the ledger of runs, below ``root``, which all executors share."""

    schemas = SCHEMAS

    def load(self, trails: DataFrame, segments: DataFrame, run: Run) -> str:
        """Load trails and segments of a run; returns ``loaded``, or ``unchanged`` if the ledger has the run as it is.

        Trails are (trail_key, trail_id, slug, name, region, reviewed_at), segments (production_key, segment_id,
        trail_key, segment_name, miles, line, reviewed_at). ValueError, with nothing changed, if the run is a demo or
        has no fingerprint, a key is missing or repeated, a trail is unknown, or an existing trail or segment has
        another identity. A known fingerprint with other particulars updates its row of the ledger and keeps its id.
        """
        if run.demo_only:
            raise ValueError("a demo artifact is not loaded")
        if not run.fingerprint:
            raise ValueError("a run needs the fingerprint of its artifact")
        number, version = self.version()
        ledger = self.read("runs", version)
        known = ledger.where(F.col("artifact_fingerprint") == run.fingerprint).first()
        run_id = known.publication_run_id if known else str(uuid.uuid5(uuid.NAMESPACE_URL, run.fingerprint))
        row = (run_id, run.fingerprint, run.algorithm_version, run.generated_at, run.diagnostics)
        if known is not None and tuple(known) == row:
            return "unchanged"
        old_trails, old_segments = self.read("trails", version), self.read("segments", version)
        assert_clean(refusals(trails, segments, old_trails, old_segments))
        marked = lambda df: df.withColumns({"publication_run_id": F.lit(run_id), "publication_artifact_fingerprint": F.lit(run.fingerprint)})
        runs = self.spark.createDataFrame([row], RUNS)
        new = self.fresh(number + 1)
        self.write(new, {"trails": merge(old_trails, marked(trails), "trail_key"), "segments": merge(old_segments, marked(segments), "production_key"), "runs": merge(ledger, runs, "artifact_fingerprint").coalesce(1)})
        self.switch(number + 1, new)
        return "loaded"
