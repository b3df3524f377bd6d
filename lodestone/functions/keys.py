"""Content-addressed keys and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import number_text

#: Fixed values that stand in keys.
SEGMENT_VERSION, MATCH_VERSION, ACTIVITY_VERSION = "segment-construction-v1", "activity-matching-v1", "activity-key-v2"
TRAIL_KEY_VERSION, SEGMENT_KEY_VERSION = "production-trail-key-v1", "production-segment-key-v1"


def joined(*parts: Column | str) -> Column:
    """Parts joined by |, an empty place for null."""
    return F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def stable_key(prefix: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(joined(*parts)), 1, 16))


def json_text(c: Column) -> Column:
    """A string as JSON writes it; null is null."""
    return F.regexp_extract(F.to_json(F.struct(c.cast("string").alias("v")), {"ignoreNullFields": "false"}), r"^\{\"v\":(.*)\}$", 1)


def json_key(prefix: str, *parts: Column | str) -> Column:
    """As stable_key, over a JSON array of the parts."""
    inner = F.concat_ws(",", *[json_text(F.lit(p) if isinstance(p, str) else p) for p in parts])
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(F.concat(F.lit("["), inner, F.lit("]"))), 1, 16))


def stable_uuid(c: Column) -> Column:
    """A uuid-shaped text from SHA-1, with version 4 and variant a."""
    h = F.sha1(c)
    s = lambda a, n: F.substring(h, a, n)
    return F.concat(s(1, 8), F.lit("-"), s(9, 4), F.lit("-4"), s(14, 3), F.lit("-a"), s(18, 3), F.lit("-"), s(21, 12))


def line_text(points: Column, places: int = 7) -> Column:
    """x,y;x,y of an array of (lon, lat)."""
    return F.array_join(F.transform(points, lambda p: F.concat(number_text(p["lon"], places), F.lit(","), number_text(p["lat"], places))), ";")


def line_fingerprint(points: Column, places: int = 7) -> Column:
    """The smaller of the texts in both directions, so that direction doesn't matter."""
    return F.least(line_text(points, places), line_text(F.reverse(points), places))


def activity_key(source: Column, source_id: Column, start: Column, components: Column) -> Column:
    """From the source's id, or without one from start time and the components' fingerprints in order."""
    prints = F.array_sort(F.transform(components, lambda c: line_fingerprint(c, 6)))
    with_id = stable_key("activity", ACTIVITY_VERSION, source, source_id)
    without = F.concat(F.lit("activity_"), F.substring(F.sha1(F.concat(joined(ACTIVITY_VERSION, source, start), F.lit("|"), F.array_join(prints, "|"))), 1, 16))
    return F.when(source_id.isNotNull() & (source_id != ""), with_id).otherwise(without)


def match_key(activity: Column, segment: Column) -> Column:
    return stable_key("activity_match", MATCH_VERSION, activity, segment)


def candidate_trail_key(item: Column, normalized: Column) -> Column:
    return json_key("candidate_trail", item, normalized)


def trail_key(candidate: Column) -> Column:
    return json_key("trail", TRAIL_KEY_VERSION, candidate)
