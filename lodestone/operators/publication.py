"""Publication: candidates from eligible segments, the gate of decisions, trail roll-ups, validation and load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import line_length, valid_point
from ..functions.keys import SEGMENT_KEY_VERSION, candidate_trail_key, json_key, line_text, stable_uuid, trail_key
from ..functions.names import slugify
from ..functions.numbers import finite, round_half_up
from .issues import duplicates, every, issues, unknown

VERIFIED = "verified_for_publication"


def candidates(segments: DataFrame, metadata: DataFrame) -> DataFrame:
    """Eligible segments (segment_key, item_key, normalized, miles, line, ids) with their candidate trail and its name and region.

    Metadata is (candidate_trail_key, display_name, region).
    """
    keyed = segments.withColumn("candidate_trail_key", candidate_trail_key(F.col("item_key"), F.col("normalized")))
    return keyed.join(metadata.select("candidate_trail_key", "display_name", "region"), "candidate_trail_key", "left")


def rollup(candidate: DataFrame) -> DataFrame:
    """One row per candidate trail: numbers, names, ids and keys as sets, and miles rounded to six places at every step.

    The steps follow the order of segment keys; a trail's segments are a few, so its list is a small one.
    """
    pairs = F.array_sort(F.collect_list(F.struct("segment_key", "miles")))
    total = F.aggregate(pairs, F.lit(0.0), lambda acc, x: round_half_up(acc + x["miles"], 6))
    return candidate.groupBy("candidate_trail_key").agg(
        F.count("*").alias("segments"),
        total.alias("miles"),
        F.first("display_name", ignorenulls=True).alias("display_name"),
        F.first("region", ignorenulls=True).alias("region"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"),
        F.array_sort(F.collect_set("segment_key")).alias("segment_keys"),
    )


def gate(candidate: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(published segments, issues): a segment is published if it and its trail are verified.

    Decisions are (target_type, target_key, decision), one per target. A verified segment whose trail isn't is an
    issue, and so is a verified trail without metadata.
    """
    d = lambda kind, key, name: decisions.where(F.col("target_type") == kind).select(F.col("target_key").alias(key), F.col("decision").alias(name))
    both = candidate.join(d("segment", "segment_key", "segment_decision"), "segment_key", "left").join(d("trail", "candidate_trail_key", "trail_decision"), "candidate_trail_key", "left")
    seg, trail = F.coalesce(F.col("segment_decision") == VERIFIED, F.lit(False)), F.coalesce(F.col("trail_decision") == VERIFIED, F.lit(False))
    wrong = issues(both, [
        ("trail_not_verified", seg & ~trail, F.concat(F.lit("trail_not_verified:"), "segment_key")),
        ("metadata_missing", seg & trail & F.col("display_name").isNull(), F.concat(F.lit("metadata_missing:"), "segment_key")),
    ])
    return published(both.where(seg & trail & F.col("display_name").isNotNull())), wrong


def segment_key(trail: Column, line: Column) -> Column:
    return json_key("segment", SEGMENT_KEY_VERSION, trail, line_text(line))


def published(rows: DataFrame) -> DataFrame:
    """Published rows with production keys, ids and slug."""
    t = trail_key(F.col("candidate_trail_key"))
    rows = rows.withColumn("trail_key", t).withColumn("production_key", segment_key(t, F.col("line")))
    return rows.withColumn("trail_id", stable_uuid(F.col("trail_key"))).withColumn("segment_id", stable_uuid(F.col("production_key"))).withColumn("slug", F.concat(slugify(F.col("display_name")), F.lit("-"), F.substring("trail_key", 7, 6)))


def diagnostics(candidate: DataFrame, decisions: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: segments verified, rejected, in review (no decision counts as that) and published, with miles."""
    own = decisions.where("target_type = 'segment'").select(F.col("target_key").alias("segment_key"), "decision")
    d = F.coalesce("decision", F.lit("needs_review"))
    a = candidate.join(own, "segment_key", "left").agg(*[F.count_if(d == k).alias(k) for k in (VERIFIED, "rejected", "needs_review")])
    b = rows.agg(F.count("*").alias("published_segments"), F.count_distinct("trail_key").alias("published_trails"), round_half_up(F.coalesce(F.sum("miles"), F.lit(0.0)), 6).alias("published_miles"))
    return a.join(F.broadcast(b))


def validate(rows: DataFrame, candidate: DataFrame, decisions: DataFrame, metadata: DataFrame, metadata_regions: list[str] | None = None) -> DataFrame:
    """rule, message of everything wrong with published rows: keys, bindings to their candidates, names, numbers, places."""
    c = candidate.select("segment_key", *[F.col(x).alias(f"c_{x}") for x in ("candidate_trail_key", "item_key", "normalized", "miles", "line", "ids", "display_name", "region")])
    own = decisions.where("target_type = 'segment'").select(F.col("target_key").alias("segment_key"), F.col("decision").alias("d_segment"))
    trail = decisions.where("target_type = 'trail'").select(F.col("target_key").alias("candidate_trail_key"), F.col("decision").alias("d_trail"))
    x = rows.join(c, "segment_key", "left").join(own, "segment_key", "left").join(trail, "candidate_trail_key", "left")
    about = lambda rule: F.concat(F.lit(f"{rule}:"), F.coalesce("segment_key", F.lit("")))
    differs = lambda f: (f"binding_{f}", ~F.col(f).eqNullSafe(F.col(f"c_{f}")), about(f"binding_{f}"))
    rule = lambda name, bad: (name, bad, about(name))
    t = trail_key(F.col("candidate_trail_key"))
    rules = [
        rule("candidate_missing", F.col("c_item_key").isNull()),
        *[differs(f) for f in ("candidate_trail_key", "item_key", "normalized", "miles", "line", "ids", "display_name", "region")],
        rule("segment_not_verified", ~F.col("d_segment").eqNullSafe(F.lit(VERIFIED))),
        rule("trail_not_verified", ~F.col("d_trail").eqNullSafe(F.lit(VERIFIED))),
        rule("unstable_trail_key", ~F.col("trail_key").eqNullSafe(t)),
        rule("unstable_segment_key", ~F.col("production_key").eqNullSafe(segment_key(t, F.col("line")))),
        rule("unstable_trail_id", ~F.col("trail_id").eqNullSafe(stable_uuid(F.col("trail_key")))),
        rule("unstable_segment_id", ~F.col("segment_id").eqNullSafe(stable_uuid(F.col("production_key")))),
        rule("blank_name", F.length(F.trim(F.coalesce("display_name", F.lit("")))) == 0),
        rule("miles_not_positive", ~(finite(F.col("miles")) & (F.col("miles") > 0))),
        rule("line_too_short", F.size("line") < 2),
        rule("invalid_place", ~F.forall("line", valid_point)),
        rule("no_source_ids", F.size("ids") < 1),
        rule("no_length", line_length(F.col("line")) <= 0),
    ]
    if metadata_regions is not None:
        rules.append(rule("unknown_region", ~F.coalesce(F.col("region").isin(*metadata_regions), F.lit(False))))
    keys = ("segment_key", "production_key", "segment_id")
    return every(issues(x, rules), *[duplicates(rows, [k], f"duplicate_{k}") for k in keys], duplicates(decisions, ["target_type", "target_key"], "duplicate_decision"), duplicates(metadata, ["candidate_trail_key"], "duplicate_metadata"), unknown(metadata, candidate, ["candidate_trail_key"], "metadata_unknown"))


def load_payload(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trail rows, segment rows) to be loaded."""
    trails = rows.groupBy("trail_key").agg(F.first("trail_id").alias("trail_id"), F.min("slug").alias("slug"), F.min("display_name").alias("name"), F.min("region").alias("region"))
    return trails, rows.select("production_key", "segment_id", "trail_key", F.col("display_name").alias("segment_name"), F.col("miles").cast("decimal(8,3)").alias("miles"), "line")


def conflicts(incoming: DataFrame, existing: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys that exist with a different value in one of the fields; null equals null."""
    old = existing.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_{f}"))
    return incoming.join(old, key).where(~same).select(F.lit(f"conflict_{key}").alias("rule"), F.concat(F.lit(f"conflict_{key}:"), F.col(key).cast("string")).alias("message"))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Existing and incoming rows with the last of each key: incoming before existing, then by ``order``.

    max_by combines in the map tasks, so no window holds all rows of a key.
    """
    rest = [c for c in existing.columns if c not in keys]
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_new", *order)).alias("_v"))
    return last.select(*keys, *[F.col("_v")[c].alias(c) for c in rest]).select(existing.columns)


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: SHA-256 over the sorted SHA-256 of rows; reordering rows changes nothing.

    Row hashes are combined in two steps: per leading two hex digits, and over the 256 of those.
    """
    h = rows.select(F.sha2(F.to_json(F.struct(*sorted(columns))), 256).alias("h"))
    parts = h.withColumn("p", F.substring("h", 1, 4)).groupBy("p").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("g"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "g"))), lambda x: x["g"]), ""), 256).alias("fingerprint"))
