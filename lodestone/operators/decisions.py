"""Review decisions: the latest one of a target, overrides, and what they leave eligible."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .issues import issues

DECISIONS = ("accepted", "rejected", "needs_review")
PUBLICATION = ("verified_for_publication", "rejected", "needs_review")


def latest(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key; max_by combines before the shuffle, so one target may fill the log."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(*keys, *[F.col("_last")[c].alias(c) for c in rest])


def override(committed: DataFrame, local: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Local rows stand before committed rows of the same key."""
    both = committed.withColumn("_rank", F.lit(0)).unionByName(local.withColumn("_rank", F.lit(1)))
    return latest(both, keys, ["_rank"]).drop("_rank")


def repeated(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Second and later rows of a key, with their number."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return log.withColumn("occurrence", F.row_number().over(w).cast("long")).where("occurrence > 1")


def valid(log: DataFrame, kinds: Sequence[str] = DECISIONS, types: Sequence[str] = ("segment", "junction", "trail")) -> DataFrame:
    """Rows that name a target, a known decision and a time that can be read."""
    text = lambda c: F.length(F.coalesce(F.trim(c), F.lit(""))) > 0
    return log.where(F.col("target_type").isin(*types) & text("target_key") & F.col("decision").isin(*kinds) & F.try_to_timestamp("review_timestamp").isNotNull())


def stored(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Decisions from JSON text: malformed documents give nothing, invalid rows go."""
    schema = "array<struct<target_type:string,target_key:string,decision:string,review_timestamp:string,notes:string>>"
    return valid(raw.select(F.explode(F.from_json(column, schema)).alias("d")).select("d.*"))


#: Fields of each kind of stored decision. Texts must be there, optional ones may be left out, lists hold
#: texts only; then the decisions and the types of target that are known.
FIELDS: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "reconciliation": (("inventoryItemKey", "reviewTimestamp"), ("notes", "selectedCandidateNormalizedName"), ("selectedSourceFeatureIds",), DECISIONS, ()),
    "segment": (("targetKey", "reviewTimestamp"), ("notes",), (), DECISIONS, ("junction", "segment")),
    "match": (("activityKey", "segmentKey", "matchKey", "reviewTimestamp", "activityMatchingAlgorithmVersion", "segmentConstructionAlgorithmVersion"), ("notes",), (), DECISIONS, ()),
    "publication": (("targetKey", "reviewTimestamp"), (), (), ("verified_for_publication", "rejected", "needs_review"), ("trail", "segment")),
}


def guarded(raw: DataFrame, kind: str, column: str = "raw") -> DataFrame:
    """Decisions of a kind in FIELDS from JSON arrays: what isn't of the kind's shape goes, and so do documents that can't be read.

    Types count as JSON has them: a number isn't a text, and a null isn't a text left out. Rows keep the other columns
    of ``raw``; fields of JSON become columns of their own names.
    """
    texts, optional, lists, kinds, types = FIELDS[kind]
    each = raw.withColumn("_v", F.explode(F.try_variant_get(F.try_parse_json(column), "$", "array<variant>"))).drop(column)
    part = lambda f, to: F.try_variant_get("_v", f"$.{f}", to)
    is_text = lambda v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))
    ok = part("decision", "string").isin(*kinds) & is_text(part("decision", "variant"))
    for f in texts:
        ok = ok & is_text(part(f, "variant"))
    for f in optional:
        ok = ok & (part(f, "variant").isNull() | is_text(part(f, "variant")))
    for f in lists:
        ok = ok & F.coalesce(F.forall(part(f, "array<variant>"), is_text), F.lit(False))
    if types:
        ok = ok & is_text(part("targetType", "variant")) & part("targetType", "string").isin(*types)
    named = [*(("targetType",) if types else ()), *texts, "decision", *optional]
    return each.where(ok).select(*[c for c in each.columns if c != "_v"], *[part(f, "string").alias(f) for f in named], *[part(f, "array<string>").alias(f) for f in lists])


def make(targets: DataFrame, decision: str, timestamp: str, notes: str | None = None) -> DataFrame:
    return targets.select("target_type", "target_key", F.lit(decision).alias("decision"), F.lit(timestamp).alias("review_timestamp"), F.nullif(F.trim(F.lit(notes or "")), F.lit("")).alias("notes"))


def export(log: DataFrame, header: DataFrame) -> DataFrame:
    """Decisions with the one-row header of their lineage beside each."""
    return log.join(F.broadcast(header.limit(1)))


def eligible_segments(segments: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments whose own, start and end decisions are all accepted, warnings about missing ones).

    Segments are (segment_key, start_key, end_key, ...); the log must hold one row per target.
    """
    d = lambda kind, key, name: log.where(F.col("target_type") == kind).select(F.col("target_key").alias(key), F.col("decision").alias(name))
    both = segments.join(d("segment", "segment_key", "own"), "segment_key", "left").join(d("junction", "start_key", "at_start"), "start_key", "left").join(d("junction", "end_key", "at_end"), "end_key", "left")
    names = ("own", "at_start", "at_end")
    ok = (F.col("own") == "accepted") & (F.col("at_start") == "accepted") & (F.col("at_end") == "accepted")
    missing = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in names]))
    warnings = both.where(F.size(missing) > 0).select("segment_key", F.array_join(missing, ",").alias("missing"))
    return both.where(ok).drop(*names), warnings


def lineage_issues(artifact: DataFrame, header: DataFrame, version: str) -> DataFrame:
    """rule, message of the lineage checks between a one-row artifact and the one-row header of its decisions."""
    a = artifact.select(F.col("generated_at").alias("a_at"), F.col("demo_only").alias("a_demo"), F.col("algorithm_version").alias("a_version")).limit(1)
    h = header.select(F.col("generated_at").alias("h_at"), F.col("demo_only").alias("h_demo"), F.col("algorithm_version").alias("h_version"), F.col("export_version").alias("e_version")).limit(1)
    both = a.join(F.broadcast(h))
    rules = [
        ("unsupported_version", ~F.col("a_version").eqNullSafe(F.lit(version))),
        ("export_version", ~F.col("e_version").eqNullSafe(F.col("a_version"))),
        ("timestamp", ~F.col("h_at").eqNullSafe(F.col("a_at"))),
        ("source_version", ~F.col("h_version").eqNullSafe(F.col("a_version"))),
        ("demo_identity", ~F.col("h_demo").eqNullSafe(F.col("a_demo"))),
    ]
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))
    return both.select(F.explode(found).alias("rule")).withColumn("message", F.col("rule"))


def publication_lineage_issues(artifact: DataFrame, segment_export: DataFrame, export: DataFrame, metadata: DataFrame, version: str) -> DataFrame:
    """rule, message of the seven checks of a publication's decisions against what they were made from.

    One row each: artifact (generated_at, demo_only, algorithm_version), segment_export (algorithm_version,
    generated_at), export (algorithm_version, source as the artifact's fields, segment_version, segment_generated_at).
    A missing value differs from any that is there, and two missing ones agree.
    """
    a = artifact.select(F.struct("generated_at", "demo_only", "algorithm_version").alias("a")).limit(1)
    s = segment_export.select(F.struct("algorithm_version", "generated_at").alias("s")).limit(1)
    e = export.select(F.struct("algorithm_version", "source", "segment_version", "segment_generated_at").alias("e")).limit(1)
    some = metadata.limit(1).agg(F.count("*").alias("n"))
    one = e.crossJoin(F.broadcast(a)).crossJoin(F.broadcast(s)).crossJoin(F.broadcast(some))  # one row each
    differs = lambda x, y: ~F.col(x).eqNullSafe(F.col(y))
    rules = [
        ("export_version", ~F.col("e.algorithm_version").eqNullSafe(F.lit(version))),
        ("source_timestamp", differs("e.source.generated_at", "a.generated_at")),
        ("source_version", differs("e.source.algorithm_version", "a.algorithm_version")),
        ("demo_identity", differs("e.source.demo_only", "a.demo_only")),
        ("segment_version", differs("e.segment_version", "s.algorithm_version")),
        ("segment_source", differs("e.segment_generated_at", "s.generated_at")),
        ("metadata_absent", F.col("n") == 0),
    ]
    return issues(one, [(name, bad, F.lit(name)) for name, bad in rules])
