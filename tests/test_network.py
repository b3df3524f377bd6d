"""Rules on a published network fire on rows damaged in one place, and none fires on a clean network; not every rule has a case."""

from dataclasses import replace

import pytest
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import geo, keys
from lodestone.operators import network as N
from lodestone.plans.queries import clean_network

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def clean(spark):
    n = clean_network(spark, SMALL)
    return N.Network(*[getattr(n, f).cache() for f in N.Network.__dataclass_fields__])


def break_rows(df, key, changes):
    """(df with row k in the order of keys changed by the k-th of (rule, column, value), [(rule, its key)])."""
    ids = [r[0] for r in df.select(key).orderBy(key).limit(len(changes)).collect()]
    assert len(ids) == len(changes)
    by: dict[str, Column] = {}
    for i, (_, c, to) in zip(ids, changes, strict=True):
        by[c] = by.get(c, F).when(F.col(key) == i, to)
    return df.withColumns({c: x.otherwise(F.col(c)) for c, x in by.items()}), [(r, i) for i, (r, _, _) in zip(ids, changes, strict=True)]


def found(df):
    return {(r.rule, r.message.removeprefix(f"{r.rule}:")) for r in df.collect()}


def seen(df, want):
    """All wanted (rule, key) are there, and nothing about rows that weren't damaged."""
    got = found(df)
    assert set(want) <= got
    assert {k for _, k in got} <= {k for _, k in want}


def test_nothing_is_wrong_with_a_clean_network(clean):
    assert found(N.network_issues(clean)) == set()


def test_keys_are_read_once_for_blanks_and_once_for_repeats(clean):
    assert N.key_issues(clean)._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation") == 11


def test_rows_of_a_small_file_are_dealt_out(spark):
    """The given parts lie in one file that one task reads; what is made of them doesn't."""
    assert len(clean_network(spark, SMALL).candidate_segments.inputFiles()) > 1


def test_text_of_a_place_is_worked_out_once(spark):
    df = spark.createDataFrame([([(-0.00000004, 10.0), (1.5, -71.1234567)],), (None,)], f"line {geo.LINE}").select(keys.json_text(keys.line_text(F.col("line"))).alias("t"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("format_string") == 2 and plan.count("to_json") == 1
    assert {r.t for r in df.collect()} == {'"0,10;1.5,-71.1234567"', "null"}


def test_an_empty_network_has_no_issue(clean):
    empty = N.Network(*[getattr(clean, f).limit(0) for f in N.Network.__dataclass_fields__])
    assert found(N.network_issues(empty)) == set()


def test_segments(clean):
    p, null = F.col("provenance"), F.lit(None)
    inside = lambda part, field, to: ("provenance", p.withField(part, p[part].withField(field, to)))
    place = lambda x, y: F.array(geo.point(F.lit(x), F.lit(y)), geo.point(F.lit(-71.0), F.lit(44.0)))
    text = F.lit("another")
    upstream = lambda part, field, to: inside("upstream", part, p["upstream"][part].withField(field, to))
    changes = [
        ("segment_trail_unknown", "trail_id", text),
        ("segment_trail_key_unknown", "trail_key", text),
        ("segment_trail_trail_key", "trail_key", text),
        ("segment_candidate_unknown", "provenance", p.withField("segment_key", text)),
        ("segment_provenance_candidate_trail_key", "provenance", p.withField("candidate_trail_key", text)),
        ("segment_trail_decision_not_verified", "provenance", p.withField("candidate_trail_key", text)),
        *[(f"segment_source_{f}", *inside("source", f, text)) for f in ("segment_key", "item_key", "display_name", "normalized", "start_key", "end_key", "provider", "lineage")],
        ("segment_source_line", *inside("source", "line", F.reverse(p["source"]["line"]))),
        ("segment_source_miles", *inside("source", "miles", p["source"]["miles"] + 0.001)),
        ("segment_source_ids", *inside("source", "ids", F.concat(p["source"]["ids"], p["source"]["ids"]))),
        ("segment_source_missing", "provenance", p.withField("source", null.cast(N.SOURCE))),
        ("segment_provenance_artifact", *inside("artifact", "generated_at", text)),
        ("segment_artifact_missing", *inside("artifact", "algorithm_version", F.lit(" "))),
        ("segment_timestamp_invalid", *inside("decision", "review_timestamp", text)),
        ("segment_line_malformed", "line", F.slice("line", 1, 1)),
        ("segment_place_missing", "line", place(None, 44.0)),
        ("segment_place_not_finite", "line", place(float("nan"), 44.0)),
        ("segment_longitude_out_of_range", "line", place(-181.0, 44.0)),
        ("segment_latitude_out_of_range", "line", place(-71.0, 90.5)),
        ("segment_no_length", "line", place(-71.0, 44.0)),
        ("segment_miles_invalid", "miles", F.lit(float("inf"))),
        ("segment_upstream_segment_not_accepted", *upstream("segment", "decision", F.lit("needs_review"))),
        ("segment_upstream_segment_target", *upstream("segment", "target_key", text)),
        ("segment_upstream_start_target", *upstream("start", "target_key", null.cast("string"))),
        ("segment_upstream_end_not_accepted", *upstream("end", "target_type", F.lit("segment"))),
    ]
    rows, want = break_rows(clean.segments, "segment_id", changes)
    seen(N.segment_issues(replace(clean, segments=rows)), want)


def test_trails(clean):
    p, text = F.col("provenance"), F.lit("another")
    changes = [
        ("trail_data_status", "data_status", F.lit("retired")),
        ("trail_verification_status", "verification_status", F.lit(None).cast("string")),
        ("trail_candidate_unknown", "provenance", p.withField("candidate_trail_key", text)),
        ("trail_metadata_display_name", "name", text),
        ("trail_metadata_region", "region", F.lit("Sandwich Range")),
        ("trail_region_invalid", "region", text),
        ("trail_candidate_normalized", "normalized", text),
        ("trail_candidate_ids", "ids", F.slice("ids", 2, 100)),
        ("trail_candidate_miles", "miles", F.col("miles") + 0.00001),
        *[(f"trail_provenance_{f}", "provenance", p.withField(f, text)) for f in ("item_key", "provider")],
        ("trail_provenance_segment_keys", "provenance", p.withField("segment_keys", F.array(text))),
        ("trail_decision_differs", "provenance", p.withField("decision", p["decision"].withField("review_timestamp", F.lit("2025-01-01")))),
        ("trail_trail_key_unstable", "trail_key", text),
        ("trail_provenance_missing", "provenance", F.when(F.lit(False), p)),
    ]
    rows, want = break_rows(clean.trails, "trail_id", changes)
    seen(N.trail_issues(replace(clean, trails=rows)), want)
    # an order of ids of one's own isn't wrong
    assert found(N.trail_issues(replace(clean, trails=clean.trails.withColumn("ids", F.reverse("ids"))))) == set()


def test_metadata_and_decisions_of_trails(clean):
    first, second, third = (r.provenance.candidate_trail_key for r in clean.trails.orderBy("trail_id").limit(3).collect())
    ids = {r.provenance.candidate_trail_key: r.trail_id for r in clean.trails.collect()}
    log = clean.decisions.where(F.col("target_key") != first).withColumn("decision", F.when(F.col("target_key") == second, "rejected").otherwise(F.col("decision")))
    broken = replace(clean, decisions=log, metadata=clean.metadata.where(F.col("candidate_trail_key") != third))
    got = found(N.trail_issues(broken))
    assert {("trail_decision_missing", ids[first]), ("trail_decision_not_verified", ids[second]), ("trail_metadata_missing", ids[third])} <= got
    assert found(N.decision_issues(broken)) == {("decision_published_despite", f"trail:{second}")}


def test_candidates(clean):
    text, s = F.lit("another"), F.col("source")
    trails = [
        ("candidate_trail_metadata_display_name", "display_name", text),
        ("candidate_trail_metadata_region", "region", text),
        *[(f"candidate_trail_{f}_missing", f, F.lit("")) for f in ("item_key", "normalized", "provider")],
        *[(f"candidate_trail_{f}_missing", f, F.array().cast("array<string>")) for f in ("ids", "segment_keys")],
        ("candidate_trail_miles_invalid", "miles", F.lit(0.0)),
    ]
    rows, want = break_rows(clean.candidate_trails, "candidate_trail_key", trails)
    assert set(want) <= found(N.candidate_issues(replace(clean, candidate_trails=rows)))
    segments = [
        ("candidate_segment_trail_unknown", "candidate_trail_key", text),
        *[(f"candidate_segment_trail_{f}", f, text) for f in ("item_key", "normalized", "provider")],
        ("candidate_segment_artifact_differs", "artifact", F.col("artifact").withField("generated_at", text)),
        ("candidate_segment_source_missing", "source", F.when(F.lit(False), s)),
        ("candidate_segment_source_start_key", "source", s.withField("start_key", text)),
        ("candidate_segment_source_metres", "source", s.withField("metres", s["metres"] + 0.01)),
    ]
    rows, want = break_rows(clean.candidate_segments, "segment_key", segments)
    seen(N.candidate_issues(replace(clean, candidate_segments=rows)), want)
    meta, want = break_rows(clean.metadata, "candidate_trail_key", [("metadata_region_invalid", "region", text)])
    assert set(want) <= found(N.candidate_issues(replace(clean, metadata=meta)))
    gone = clean.metadata.limit(1).withColumn("candidate_trail_key", text)
    got = found(N.candidate_issues(replace(clean, metadata=gone)))
    assert ("metadata_trail_unknown", "another") in got and len([r for r, _ in got if r == "candidate_trail_metadata_missing"]) == clean.candidate_trails.count()


def test_keys(clean):
    twice = lambda df: df.unionByName(df.orderBy(df.columns[0]).limit(1))
    got = {r for r, _ in found(N.key_issues(N.Network(*[twice(getattr(clean, f)) for f in N.Network.__dataclass_fields__])))}
    assert got == {f"{a}_duplicate_{b}" for a, b in (("candidate_trail", "candidate_trail_key"), ("candidate_segment", "segment_key"), ("metadata", "candidate_trail_key"), ("trail", "trail_id"), ("trail", "trail_key"), ("trail", "slug"), ("segment", "segment_id"), ("segment", "production_key"), ("segment", "slug"))} | {"decision_duplicate"}
    blank = replace(clean, trails=clean.trails.withColumn("slug", F.lit(" ")), segments=clean.segments.withColumn("production_key", F.lit(None).cast("string")))
    assert {r for r, _ in found(N.key_issues(blank))} == {"trail_missing_slug", "segment_missing_production_key"}


def test_decisions(clean):
    rows, want = break_rows(clean.decisions.where("target_type = 'segment'"), "target_key", [("decision_timestamp_invalid", "review_timestamp", F.lit("soon")), ("decision_segment_unknown", "target_key", F.lit("another"))])
    got = found(N.decision_issues(replace(clean, decisions=rows)))
    assert got == {(want[0][0], f"segment:{want[0][1]}"), ("decision_segment_unknown", "segment:another")}
    other = clean.decisions.limit(1).withColumns({"target_type": F.lit("trail"), "target_key": F.lit("another")})
    assert found(N.decision_issues(replace(clean, decisions=other))) == {("decision_trail_unknown", "trail:another")}


@pytest.mark.parametrize(
    ("column", "value", "rule"),
    [
        ("algorithm_version", "'old'", "header_algorithm_version"),
        ("trail_key_version", "cast(null as string)", "header_trail_key_version"),
        ("segment_key_version", "'old'", "header_segment_key_version"),
        ("demo_only", "cast(null as boolean)", "header_demo_only_missing"),
        ("demo_only", "false", "demo_mixed"),
        ("source", f"cast(null as {N.ARTIFACT})", "header_source_missing"),
        ("source", "named_struct('generated_at', ' ', 'demo_only', true, 'algorithm_version', 'x')", "header_source_generated_at"),
        ("source", "named_struct('generated_at', 'x', 'demo_only', cast(null as boolean), 'algorithm_version', 'x')", "header_source_demo_only"),
        ("decision_source", "named_struct('generated_at', 'x', 'demo_only', true, 'algorithm_version', '')", "header_decision_source_algorithm_version"),
        ("decision_source", "named_struct('generated_at', 'x', 'demo_only', true, 'algorithm_version', 'x')", "header_sources_differ"),
    ],
)
def test_header(clean, column, value, rule):
    assert {r for r, _ in found(N.header_issues(replace(clean, header=clean.header.withColumn(column, F.expr(value)))))} == {rule}
