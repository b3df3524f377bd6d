"""Gate, roll-up, validation and load of what is published, rule by rule."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import decisions, issues, publication, reconcile

POINT = "array<struct<lon:double,lat:double>>"
CANDIDATE = f"segment_key string, item_key string, normalized string, miles double, line {POINT}, ids array<string>"
DECISIONS = "target_type string, target_key string, decision string"
V = publication.VERIFIED


def line(k, n=3):
    return [(-71.6 + 0.01 * i, 44.0 + 0.1 * k) for i in range(n)]


@pytest.fixture(scope="module")
def world(spark):
    segments = spark.createDataFrame(
        [("s1", "i1", "north ridge", 1.25, line(1), ["2", "1"]), ("s2", "i1", "north ridge", 0.1234567, line(2), ["3", "1"]), ("s3", "i2", "south pond", 2.0, line(3), ["9"]), ("s4", "i3", "old road", 1.0, line(4), ["7"])], CANDIDATE
    )
    metadata = segments.select(publication.candidate_trail_key(F.col("item_key"), F.col("normalized")).alias("candidate_trail_key"), F.initcap("normalized").alias("display_name"), F.lit("East").alias("region")).where("display_name <> 'Old Road'").distinct()
    candidate = publication.candidates(segments, metadata)
    trails = {r.segment_key: r.candidate_trail_key for r in candidate.collect()}
    log = spark.createDataFrame([("segment", "s1", V), ("segment", "s2", V), ("segment", "s3", V), ("segment", "s4", V), ("trail", trails["s1"], V), ("trail", trails["s3"], "needs_review"), ("trail", trails["s4"], V)], DECISIONS)
    rows, wrong = publication.gate(candidate, log)
    return candidate, metadata, log, rows.cache(), wrong


def rules(df):
    return sorted(r.rule for r in df.collect())


def test_gate_takes_what_is_verified_and_names_the_rest(world):
    _, _, _, rows, wrong = world
    assert sorted(r.segment_key for r in rows.collect()) == ["s1", "s2"]
    assert sorted(r.message for r in wrong.collect()) == ["metadata_missing:s4", "trail_not_verified:s3"]
    with pytest.raises(ValueError, match="metadata_missing:s4"):
        issues.assert_clean(wrong)
    issues.assert_clean(wrong.limit(0))


def test_keys_are_stable_and_distinct(world):
    rows = world[3].collect()
    assert len({r.trail_key for r in rows}) == 1 and len({r.production_key for r in rows}) == 2
    assert all(r.slug.startswith("north-ridge-") and r.trail_key.startswith("trail_") and r.segment_id[14] == "4" for r in rows)


def test_rollup_sums_and_sorts(world):
    r = publication.rollup(world[0].where("item_key = 'i1'")).collect()[0]
    assert (r.segments, r.miles, r.ids, r.segment_keys, r.display_name) == (2, 1.373457, ["1", "2", "3"], ["s1", "s2"], "North Ridge")


def test_diagnostics_count_every_decision(spark, world):
    candidate, _, log, rows, _ = world
    log = log.where("target_key <> 's4'").withColumn("decision", F.when(F.col("target_key") == "s3", "rejected").otherwise(F.col("decision")))
    r = publication.diagnostics(candidate, log, rows).collect()[0]
    assert (r[V], r.rejected, r.needs_review, r.published_segments, r.published_trails, r.published_miles) == (2, 1, 1, 2, 1, 1.373457)


def test_a_clean_publication_has_no_issue(world):
    candidate, metadata, log, rows, _ = world
    metadata = metadata.where("display_name <> 'none'")
    assert rules(publication.validate(rows, candidate, log, metadata, ["East"])) == []


@pytest.mark.parametrize(
    "column, value, expected",
    [
        ("trail_key", "'trail_x'", {"unstable_trail_key", "unstable_trail_id"}),
        ("trail_id", "'x'", {"unstable_trail_id"}),
        ("production_key", "'segment_x'", {"unstable_segment_key", "unstable_segment_id"}),
        ("segment_id", "'x'", {"unstable_segment_id"}),
        ("item_key", "'i9'", {"binding_item_key"}),
        ("normalized", "'else'", {"binding_normalized"}),
        ("ids", "cast(array() as array<string>)", {"binding_ids", "no_source_ids"}),
        ("miles", "0.0D", {"binding_miles", "miles_not_positive"}),
        ("miles", "double('NaN')", {"binding_miles", "miles_not_positive"}),
        ("display_name", "'  '", {"binding_display_name", "blank_name"}),
        ("region", "'Nowhere'", {"binding_region", "unknown_region"}),
        ("line", "slice(line, 1, 1)", {"binding_line", "line_too_short", "no_length", "unstable_segment_key"}),
        ("line", "transform(line, p -> named_struct('lon', 181D, 'lat', p.lat))", {"binding_line", "invalid_place", "no_length", "unstable_segment_key"}),
        ("line", "transform(line, p -> named_struct('lon', p.lon, 'lat', 91D))", {"binding_line", "invalid_place", "unstable_segment_key"}),
        ("segment_key", "'s9'", {"candidate_missing", "segment_not_verified", *[f"binding_{f}" for f in ("candidate_trail_key", "item_key", "normalized", "miles", "line", "ids", "display_name", "region")]}),
    ],
)
def test_a_changed_field_is_found(world, column, value, expected):
    candidate, metadata, log, rows, _ = world
    changed = rows.where("segment_key = 's1'").withColumn(column, F.expr(value))
    assert set(rules(publication.validate(changed, candidate, log, metadata, ["East"]))) == expected


def test_duplicates_and_unknown_rows_are_found(world):
    candidate, metadata, log, rows, _ = world
    found = publication.validate(rows.unionByName(rows.where("segment_key = 's2'")), candidate, log.unionByName(log.limit(1)), metadata.unionByName(metadata.limit(1)).unionByName(metadata.limit(1).withColumn("candidate_trail_key", F.lit("z"))))
    assert {"duplicate_segment_key", "duplicate_production_key", "duplicate_segment_id", "duplicate_decision", "duplicate_metadata", "metadata_unknown"} <= set(rules(found))


def test_payload_and_fingerprint(world):
    rows = world[3]
    trails, segments = publication.load_payload(rows)
    assert trails.count() == 1 and sorted(str(r.miles) for r in segments.collect()) == ["0.123", "1.250"]
    f = lambda df: publication.fingerprint(df, ["segment_key", "miles", "line"]).collect()[0].fingerprint
    assert f(rows) == f(rows.orderBy(F.desc("segment_key")).repartition(3)) != f(rows.withColumn("miles", F.col("miles") + 1))


def test_stored_decisions_leave_out_what_is_not_valid(spark):
    good = '{"target_type":"segment","target_key":"s1","decision":"accepted","review_timestamp":"2026-01-02T03:04:05Z"}'
    bad = [good.replace("accepted", "maybe"), good.replace('"s1"', '" "'), good.replace("2026-01-02T03:04:05Z", "yesterday"), good.replace("segment", "planet")]
    raw = spark.createDataFrame([(f"[{','.join([good, *bad])}]",), ("not json",), (None,), ("{}",)], "raw string")
    assert [(r.target_key, r.decision, r.notes) for r in decisions.stored(raw).collect()] == [("s1", "accepted", None)]


def test_decisions_made_and_exported(spark):
    targets = spark.createDataFrame([("segment", "s1"), ("junction", "j1")], "target_type string, target_key string")
    made = decisions.make(targets, "rejected", "2026-01-02T03:04:05Z", "  ")
    assert {(r.target_key, r.decision, r.notes) for r in made.collect()} == {("s1", "rejected", None), ("j1", "rejected", None)}
    assert decisions.valid(made).count() == 2
    header = spark.createDataFrame([("v1",)], "export_version string")
    assert {r.export_version for r in decisions.export(made, header).collect()} == {"v1"}


@pytest.mark.parametrize(
    "change, expected",
    [({}, []), ({"generated_at": "b"}, ["timestamp"]), ({"demo_only": True}, ["demo_identity"]), ({"algorithm_version": "v0"}, ["source_version"]), ({"export_version": "v0"}, ["export_version"])],
)
def test_lineage(spark, change, expected):
    kinds = "generated_at string, demo_only boolean, algorithm_version string, export_version string"
    row = {"generated_at": "a", "demo_only": False, "algorithm_version": "v1", "export_version": "v1"}
    one = lambda r: spark.createDataFrame([tuple(r.values())], kinds)
    assert rules(decisions.lineage_issues(one(row), one(row | change), "v1")) == expected
    assert "unsupported_version" in rules(decisions.lineage_issues(one(row), one(row), "v2"))


GOOD = {
    "reconciliation": {"inventoryItemKey": "i", "selectedSourceFeatureIds": ["1", "2"], "decision": "accepted", "reviewTimestamp": "t"},
    "segment": {"targetType": "junction", "targetKey": "j", "decision": "rejected", "reviewTimestamp": "t"},
    "match": {"activityKey": "a", "segmentKey": "s", "matchKey": "m", "decision": "needs_review", "reviewTimestamp": "t", "activityMatchingAlgorithmVersion": "v", "segmentConstructionAlgorithmVersion": "v"},
    "publication": {"targetType": "trail", "targetKey": "t", "decision": V, "reviewTimestamp": "t"},
}


@pytest.mark.parametrize("kind", GOOD)
def test_stored_decisions_are_guarded_by_kind(spark, kind):
    good = GOOD[kind]
    texts = [f for f in good if isinstance(good[f], str)]
    bad = [*[{f: v for f, v in good.items() if f != gone} for gone in good], *[good | {f: 7} for f in texts], *[good | {f: None} for f in good], good | {"decision": "maybe"}]
    if kind != "publication":
        bad += [good | {"notes": None}, good | {"notes": 3}]
    if "targetType" in good:
        bad.append(good | {"targetType": "region"})
    if kind == "reconciliation":
        bad += [good | {"selectedSourceFeatureIds": ["1", 2]}, good | {"selectedSourceFeatureIds": "1"}, good | {"selectedCandidateNormalizedName": 1}]
    more = [good | {"notes": "n"}] + ([good | {"selectedSourceFeatureIds": []}] if kind == "reconciliation" else [])
    raw = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate([[good, *more], bad, good, [1, "x", None, []]])] + [(9, "[{"), (10, None)], "n int, raw string")
    got = decisions.guarded(raw, kind).collect()
    assert [r.n for r in got] == [0] * (1 + len(more))
    assert all(r.decision == good["decision"] for r in got)


@pytest.mark.parametrize(
    "change, expected",
    [
        ({}, []),
        ({"algorithm_version": "p0"}, ["export_version"]),
        ({"source": ("b", False, "v1")}, ["source_timestamp"]),
        ({"source": ("a", False, "v0")}, ["source_version"]),
        ({"source": ("a", None, "v1")}, ["demo_identity"]),
        ({"source": None}, ["demo_identity", "source_timestamp", "source_version"]),
        ({"segment_version": None}, ["segment_version"]),
        ({"segment_generated_at": "b"}, ["segment_source"]),
    ],
)
def test_lineage_of_a_publication(spark, change, expected):
    row = {"algorithm_version": "p1", "source": ("a", False, "v1"), "segment_version": "v1", "segment_generated_at": "a"} | change
    export = spark.createDataFrame([tuple(row.values())], "algorithm_version string, source struct<generated_at:string,demo_only:boolean,algorithm_version:string>, segment_version string, segment_generated_at string")
    artifact = spark.createDataFrame([("a", False, "v1")], "generated_at string, demo_only boolean, algorithm_version string")
    metadata = spark.createDataFrame([("t",)], "candidate_trail_key string")
    check = lambda m: rules(decisions.publication_lineage_issues(artifact, artifact, export, m, "p1"))
    assert check(metadata) == expected
    assert check(metadata.limit(0)) == sorted([*expected, "metadata_absent"])


def test_ids_of_candidate_and_group_must_agree(spark):
    items = spark.createDataFrame([("i1",)], "item_key string")
    groups = spark.createDataFrame([("north ridge", "North Ridge", ["1", "2"])], "normalized string, display_name string, ids array<string>")
    d = spark.createDataFrame([("i1", "north ridge", ["1", "2"], "accepted")], "item_key string, selected string, selected_ids array<string>, decision string")
    found = lambda ids: spark.createDataFrame([("i1", "north ridge", ids)], "item_key string, normalized string, ids array<string>")
    good, wrong = reconcile.accepted_sources(d, items, found(["2", "1"]), groups)
    assert good.count() == 1 and wrong.count() == 0
    good, wrong = reconcile.accepted_sources(d, items, found(["1"]), groups)
    assert good.count() == 0 and [r.message for r in wrong.collect()] == ["candidate and group ids disagree:i1"]
