from pyspark.sql import functions as F

from lodestone.operators import workspace as w

RAW = "id string, slug string, trail_id string, trail_name string, segment_name string, trail_region string, miles string, coordinates string, provenance string, source_feature_ids string, source_label string, source_ref string, geometry_manually_modified boolean, reviewed_at string"


def raw(spark, **over):
    base = {"id": "1", "coordinates": "[[-71, 44.5], [-71.1, 44.6, 900]]", "miles": " 1.50 "}
    names = [c.split()[0] for c in RAW.split(", ")]
    return w.decode_rows(spark.createDataFrame([tuple({**base, **over}.get(n) for n in names)], RAW)).collect()


def test_decoded_row(spark):
    r = raw(spark, provenance='{"provider": "OSM", "dataset": " ", "sourceUrl": 3, "manuallyModified": "no", "notes": "x", "reviewedAt": "2024"}', source_feature_ids='["a", 1, null, "b"]', source_label="label", source_ref="ref")[0]
    assert (r.miles, r.coordinates, r.provider, r.dataset, r.source_feature_ids) == (1.5, [[-71.0, 44.5], [-71.1, 44.6]], "OSM", "label", ["a", "b"])
    assert (r.source_url, r.imported_at, r.manually_modified, r.reviewed_at, r.notes, r.completed) == ("ref", None, True, "2024", "x", False)


def test_defaults_of_a_row_without_provenance(spark):
    for text in (None, "{", "[]", "null"):
        r = raw(spark, provenance=text, source_feature_ids=text, miles=None)[0]
        assert (r.provider, r.dataset, r.source_feature_ids, r.manually_modified, r.miles) == ("other", "trail segment view", [], False, None)


def test_rows_with_malformed_coordinates_go(spark):
    for text in (None, "", "{}", "[]", "[[1, 2]]", '[[1, 2], ["3", 4]]', "[[1, 2], [3]]", "[[1, 2], null]", "[[1, 2], [null, 3]]", "[[1, 2], 3]"):
        assert raw(spark, coordinates=text) == [], text


def test_truth_of_values(spark):
    for value, want in (("true", True), ("false", False), ("0", False), ("0.0", False), ("2", True), ('""', False), ('"false"', True), ("null", False), ("[]", True), ("{}", True)):
        assert raw(spark, provenance=f'{{"manuallyModified": {value}}}')[0].manually_modified is want, value
    assert raw(spark, provenance='{"manuallyModified": true}', geometry_manually_modified=False)[0].manually_modified is False


def test_filters_of_topology(spark):
    j = spark.createDataFrame([("a", "needs_review", ["ambiguous_near_intersection"]), ("b", "proposed", []), ("c", None, None)], "k string, status string, reasons array<string>")
    shown = lambda s: sorted(r.k for r in w.visible_junctions(j, s).collect())
    assert [shown(s) for s in ("all", "junctions", "needs_review", "near_intersections", "segments")] == [["a", "b", "c"], ["a", "b", "c"], ["a"], ["a"], []]
    s = spark.createDataFrame([("a", "needs_review", ["very_short_segment"]), ("b", "proposed", ["disconnected_component"])], "k string, status string, flags array<string>")
    assert [[r.k for r in w.visible_segments(s, f).collect()] for f in ("needs_review", "short_segments", "disconnected", "junctions")] == [["a"], ["a"], ["b"], []]


def test_decision_in_effect(spark):
    d = "target_type string, target_key string, decision string"
    committed = spark.createDataFrame([("segment", "a", "rejected"), ("segment", "b", "verified_for_publication"), ("trail", "c", "rejected")], d)
    local = spark.createDataFrame([("segment", "a", "verified_for_publication")], d)
    s = spark.createDataFrame([("a",), ("b",), ("c",)], "segment_key string")
    shown = lambda f: sorted(r.segment_key for r in w.visible_publication(s, committed, local, f).collect())
    assert [shown(f) for f in ("all", "verified", "rejected", "needs_review")] == [["a", "b", "c"], ["a", "b"], [], []]


def test_rows_handed_on(spark):
    p = spark.range(1).select(*[F.lit(c).alias(c) for c in ("segment_id", "slug", "trail_id", "display_name", "segment_name", "region", "reviewed_at", "production_key", "item_key", "normalized", "start_key", "end_key", "segment_decision", "start_decision", "end_decision", "algorithm_version")],
        F.lit(1.0).alias("miles"), F.lit(2.0).alias("metres"), F.expr("array(array(1D, 2D, 3D), array(4D, 5D))").alias("coordinates"), F.expr("array(1)").alias("line"), F.lit("elsewhere").alias("provider"), F.expr("array('i')").alias("ids"), F.lit(None).cast("boolean").alias("snapped"), F.lit(True).alias("split"))
    r = w.served_segments(p).first()
    assert (r.id, r.completed, r.coordinates, r.provider, r.manually_modified) == ("segment_id", False, [[1.0, 2.0], [4.0, 5.0]], "other", True)
    m = w.matching_segments(p).first()
    assert (m.segment_key, m.evidence.start_decision, m.evidence.version) == ("production_key", "start_decision", "algorithm_version")


def test_messages_and_names(spark):
    df = spark.createDataFrame([("x PROFILES_username_format_chk and duplicate key",), ("Duplicate Key",), ("secret",), (None,), (w.NAME_TAKEN,)], "m string")
    assert [r[0] for r in df.select(w.safe_error(F.col("m"))).collect()] == [w.NAME_FORMAT, w.NAME_TAKEN, w.UPDATE_FAILED, w.UPDATE_FAILED, w.UPDATE_FAILED]
    assert [r[0] for r in df.select(w.shown_error(F.col("m"))).collect()] == [w.UPDATE_FAILED] * 4 + [w.NAME_TAKEN]
    n = spark.createDataFrame([(" Ann ", "B"), (None, "Bo"), (" ", "C"), (None, None), ("x" * 130, None)], "f string, n string")
    assert [r[0] for r in n.select(w.default_name(F.col("f"), F.col("n"))).collect()] == ["Ann", "Bo", None, None, "x" * 120]
    assert w.profiles(spark.createDataFrame([("1", None, None, None)], "id string, username string, display_name string, is_public boolean")).first().is_public is False
