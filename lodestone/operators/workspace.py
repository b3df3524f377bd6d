"""Review workspaces: what a filter shows, decisions in effect, rows handed on to serving and matching, rows of the API decoded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import lenient_number
from .decisions import override

#: Providers that are named, messages a user may see, and the parts of errors that lead to them.
PROVIDERS = ("USFS", "OSM", "manual", "demo")
UPDATE_FAILED, NAME_FORMAT, NAME_TAKEN = "Profile update failed. Please try again.", "Username does not match the required public format.", "That username is already taken."
ERRORS = (("profiles_username_format_chk", NAME_FORMAT), ("profiles_username_key", NAME_TAKEN), ("duplicate key", NAME_TAKEN))
POTENTIAL = "classification <> 'insufficient_coverage'"


def visible_junctions(junctions: DataFrame, show: str = "all") -> DataFrame:
    """Junctions (status, reasons) for all, junctions, needs_review or near_intersections; none for another filter."""
    rules = {"all": F.lit(True), "junctions": F.lit(True), "needs_review": F.col("status") == "needs_review", "near_intersections": F.array_contains("reasons", "ambiguous_near_intersection")}
    return junctions.where(rules.get(show, F.lit(False)))


def visible_segments(segments: DataFrame, show: str = "all") -> DataFrame:
    """Segments (status, flags) for all, segments, needs_review, short_segments or disconnected; none for another filter."""
    rules = {"all": F.lit(True), "segments": F.lit(True), "needs_review": F.col("status") == "needs_review", "short_segments": F.array_contains("flags", "very_short_segment"), "disconnected": F.array_contains("flags", "disconnected_component")}
    return segments.where(rules.get(show, F.lit(False)))


def visible_matches(matches: DataFrame, show: str = "all") -> DataFrame:
    """Matches for all, matched_segments (potential evidence), unmatched_activities (of activities without any), or one class."""
    if show == "all":
        return matches
    if show == "matched_segments":
        return matches.where(POTENTIAL)
    if show == "unmatched_activities":
        return matches.join(matches.where(POTENTIAL).select("activity_key").distinct(), "activity_key", "left_anti")
    return matches.where(F.col("classification") == show)


def visible_publication(segments: DataFrame, committed: DataFrame, local: DataFrame, show: str = "all") -> DataFrame:
    """Segments with the decision in effect (the local one before the committed one) for all, verified or a decision.

    Decisions are (target_type, target_key, decision), one row per target.
    """
    effect = override(committed, local, ["target_type", "target_key"]).where("target_type = 'segment'").select(F.col("target_key").alias("segment_key"), "decision")
    both = segments.join(effect, "segment_key", "left")
    return both if show == "all" else both.where(F.col("decision") == ("verified_for_publication" if show == "verified" else show))


def provider(c: Column) -> Column:
    return F.when(c.isin(*PROVIDERS), c).otherwise("other")


def flat_line(line: Column) -> Column:
    """Coordinates of two numbers; elevations go."""
    return F.transform(line, lambda p: F.slice(p, 1, 2))


def served_segments(published: DataFrame) -> DataFrame:
    """Published segments as they are served: none completed, provider named or other, coordinates without elevation.

    Published rows are (segment_id, slug, trail_id, display_name, segment_name, region, miles, coordinates, provider, ids,
    snapped, split, reviewed_at).
    """
    return published.select(
        F.col("segment_id").alias("id"), "slug", "trail_id", F.col("display_name").alias("trail_name"), "segment_name", "region", "miles", F.lit(False).alias("completed"),
        flat_line(F.col("coordinates")).alias("coordinates"), provider(F.col("provider")).alias("provider"), F.lit("verified publication artifact").alias("dataset"), F.col("ids").alias("source_feature_ids"),
        (F.coalesce("snapped", F.lit(False)) | F.coalesce("split", F.lit(False))).alias("manually_modified"), "reviewed_at",
    )


def matching_segments(published: DataFrame) -> DataFrame:
    """Published segments as matching takes them, with the keys of the segment and junctions they come from as evidence."""
    evidence = F.struct("segment_decision", "start_decision", "end_decision", F.col("algorithm_version").alias("version"))
    return published.select(F.col("production_key").alias("segment_key"), "item_key", "display_name", "normalized", "start_key", "end_key", "line", "metres", "ids", provider(F.col("provider")).alias("provider"), evidence.alias("evidence"))


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).rlike(f"^({kind})"), F.lit(False))


def _text_at(v: Column, path: str) -> Column:
    """Text that isn't blank; other kinds of values are null."""
    t = F.try_variant_get(v, path, "variant")
    return F.when(_is(t, "STRING") & (F.trim(t.cast("string")) != ""), t.cast("string"))


def _truth(v: Column) -> Column:
    """False for absent, null, false, zero and empty text; true for the rest."""
    text = v.cast("string")
    nothing = v.isNull() | _is(v, "VOID") | (_is(v, "BOOLEAN") & (text == "false")) | (_is(v, "STRING") & (text == "")) | (_is(v, _NUMBER) & (text.try_cast("double") == 0))
    return ~F.coalesce(nothing, F.lit(True))


_NUMBER = "BIGINT|DOUBLE|DECIMAL|FLOAT"


def decode_rows(raw: DataFrame) -> DataFrame:
    """Rows of the API decoded; a row whose coordinates aren't an array of two or more number pairs goes.

    ``raw`` is (id, slug, trail_id, trail_name, segment_name, trail_region, miles, coordinates, provenance,
    source_feature_ids, source_label, source_ref, geometry_manually_modified, reviewed_at), all text but the boolean;
    coordinates, provenance and source_feature_ids are JSON, of which malformed text is as none.
    """
    points = F.try_variant_get(F.try_parse_json("coordinates"), "$", "array<variant>")
    number = lambda p, i: _is(F.try_variant_get(p, f"$[{i}]", "variant"), _NUMBER)
    good = (F.size(points) >= 2) & F.forall(points, lambda p: number(p, 0) & number(p, 1))
    ids = F.try_variant_get(F.try_parse_json("source_feature_ids"), "$", "array<variant>")
    p = F.try_parse_json("provenance")
    named = _text_at(p, "$.provider")
    kept = raw.where(F.coalesce(good, F.lit(False)))
    return kept.select(
        "id", "slug", "trail_id", "trail_name", "segment_name", F.col("trail_region").alias("region"), lenient_number(F.col("miles")).alias("miles"), F.lit(False).alias("completed"),
        F.transform(points, lambda x: F.array(F.try_variant_get(x, "$[0]", "double"), F.try_variant_get(x, "$[1]", "double"))).alias("coordinates"),
        F.coalesce(provider(named), F.lit("other")).alias("provider"),
        F.coalesce(_text_at(p, "$.dataset"), "source_label", F.lit("trail segment view")).alias("dataset"),
        F.coalesce(F.transform(F.filter(ids, lambda x: _is(x, "STRING")), lambda x: x.cast("string")), F.array().cast("array<string>")).alias("source_feature_ids"),
        F.coalesce(_text_at(p, "$.sourceUrl"), "source_ref").alias("source_url"),
        _text_at(p, "$.importedAt").alias("imported_at"),
        F.coalesce("geometry_manually_modified", _truth(F.try_variant_get(p, "$.manuallyModified", "variant"))).alias("manually_modified"),
        F.coalesce("reviewed_at", _text_at(p, "$.reviewedAt")).alias("reviewed_at"),
        _text_at(p, "$.notes").alias("notes"),
    )


def safe_error(message: Column) -> Column:
    """The message a user sees for an error of storing a profile."""
    out = F.lit(UPDATE_FAILED)
    for part, shown in reversed(ERRORS):
        out = F.when(F.contains(F.lower(message), F.lit(part)), F.lit(shown)).otherwise(out)
    return out


def shown_error(message: Column) -> Column:
    """The message itself if a user may see it."""
    return F.when(message.isin(UPDATE_FAILED, NAME_FORMAT, NAME_TAKEN), message).otherwise(UPDATE_FAILED)


def default_name(full_name: Column, name: Column) -> Column:
    """The display name of a new profile: the first name that isn't null, trimmed, null if blank, at most 120 characters."""
    return F.left(F.nullif(F.trim(F.coalesce(full_name, name)), F.lit("")), F.lit(120))


def profiles(raw: DataFrame) -> DataFrame:
    """Rows of profiles (id, username, display_name, is_public), never null in is_public."""
    return raw.select("id", "username", "display_name", F.coalesce("is_public", F.lit(False)).alias("is_public"))
