"""Activities against a straight segment of 1.6 km: whole, reversed, beside it, in parts, and changed afterwards."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import matching, reconcile, traces

POINTS = "activity_key string, component_idx int, point_idx int, lon double, lat double"
LINE = "segment_key string, line array<struct<lon:double,lat:double>>"
#: Degrees of a step of 40 m at latitude 44, and of a metre north.
STEP, METRE = 0.0005, 1 / 111_320


def trace(key, steps=range(41), north=0.0, component=0, jitter=0.0):
    rng = random.Random(4)
    return [(key, component, i, -71.6 + STEP * k, 44.0 + METRE * (north + rng.uniform(-jitter, jitter))) for i, k in enumerate(steps)]


@pytest.fixture(scope="module")
def matched(spark):
    rows = [
        *trace("whole"),
        *trace("reversed", range(40, -1, -1)),
        *trace("jitter", jitter=6.0),
        *trace("parallel", north=150.0),
        *trace("half", range(21)),
        *trace("two parts", range(21)),
        *trace("two parts", range(21, 41), component=1),
        *trace("jump", [*range(18), *range(23, 41)]),
    ]
    points = spark.createDataFrame(rows, POINTS)
    segments = spark.createDataFrame([("s", [(-71.6 + STEP * k, 44.0) for k in range(41)])], LINE)
    return points, segments, matching.match(points, segments).cache()


def test_classes(matched):
    got = {r.activity_key: r for r in matched[2].collect()}
    assert {k for k, r in got.items() if r.classification == "strong_candidate"} == {"whole", "reversed", "jitter"}
    assert got["whole"].coverage == got["reversed"].coverage == 1.0 and got["jitter"].median_distance < 8
    assert "parallel" not in got or got["parallel"].classification == "insufficient_coverage"
    assert 0.4 < got["half"].coverage < 0.6 and got["half"].strong_component is None
    assert got["two parts"].coverage > 0.95 and got["two parts"].strong_component is None and got["two parts"].classification == "needs_review"
    assert got["jump"].ignored_edges == 1 and got["jump"].classification != "strong_candidate"


def test_first_and_last_matched_follow_the_segment(matched):
    r = {x.activity_key: x for x in matched[2].collect()}
    assert r["whole"].first_matched is not None and r["whole"].last_matched is not None


def test_counts(matched):
    points, segments, found = matched
    d = matching.diagnostics(found, points, segments).collect()[0]
    assert (d.activities, d.segments, d.considered, d.strong_candidate) == (7, 1, 7, 3) and d.box_rejected == 7 - found.count()
    assert "whole" not in {r.activity_key for r in matching.unmatched(points, found).collect()}


def test_a_finished_table_is_clean_and_changes_are_found(matched):
    found = matched[2]
    rules = lambda df: {r.rule for r in matching.artifact_issues(df).collect()}
    assert rules(found) == set()
    one = found.where("activity_key = 'whole'")
    assert rules(one.withColumn("match_key", F.lit("x"))) == {"unstable_key"}
    assert rules(one.withColumn("coverage", F.lit(1.5))) == {"outside_coverage"}
    assert "non_finite_max_gap" in rules(one.withColumn("max_gap", F.lit(float("nan"))))
    assert "negative_max_distance" in rules(one.withColumn("max_distance", F.lit(-1.0)))
    assert rules(one.withColumn("classification", F.lit("candidate"))) == {"classification"}
    assert {"classification", "strong_below_thresholds"} == rules(one.withColumn("median_distance", F.lit(500.0)).withColumn("p95_distance", F.lit(500.0)))
    assert rules(one.unionByName(one)) == {"duplicate_pair"}


def test_trusted_edges_leave_out_the_jump(matched):
    e = traces.trusted_edges(matched[0]).groupBy("activity_key").count()
    assert {r.activity_key: r["count"] for r in e.collect()} == {"whole": 40, "reversed": 40, "jitter": 40, "parallel": 40, "half": 20, "two parts": 39, "jump": 34}


def test_accepted_sources_name_what_is_wrong(spark):
    items = spark.createDataFrame([("i1",), ("i2",)], "item_key string")
    found = spark.createDataFrame([("i1", "north ridge"), ("i1", "lost"), ("i2", "south pond")], "item_key string, normalized string")
    groups = spark.createDataFrame([("north ridge", "North Ridge", ["1", "2"]), ("south pond", "South Pond", ["3"])], "normalized string, display_name string, ids array<string>")
    d = spark.createDataFrame(
        [("i1", "north ridge", ["2", "1"], "accepted"), ("i2", "south pond", ["3", "4"], "accepted"), ("i2", "north ridge", ["1", "2"], "accepted"), ("i1", "lost", ["1"], "accepted"), ("i1", " ", [], "accepted"), ("i9", "north ridge", ["1"], "accepted"), ("i9", "x", [], "rejected")],
        "item_key string, selected string, selected_ids array<string>, decision string",
    )
    good, wrong = reconcile.accepted_sources(d, items, found, groups)
    assert [(r.item_key, r.normalized, r.display_name) for r in good.collect()] == [("i1", "north ridge", "North Ridge")]
    assert sorted(r.message for r in wrong.collect()) == ["candidate name required:i1", "candidate not found:i2", "group not found:i1", "item not found:i9", "selected ids must match exactly:i2"]


def test_figures_of_many_rows_at_once(spark):
    rng = random.Random(3)
    rows = [(k, [float(rng.choice([1.0, 24.999, 25.0, 25.001, 90.5])) for _ in range(rng.choice([1, 2, 3, 20, 41]))]) for k in range(300)]
    got = {r.k: r for r in matching.metrics(spark.createDataFrame(rows, "k int, d array<double>"), ["k"]).collect()}
    assert len(got) == 300
    for k, d in rows:
        r, ranked, runs, now = got[k], sorted(d), [0], 0
        for x in d:
            now = now + 1 if x > 25.0 else 0
            runs.append(now)
        half = (len(d) + 1) // 2
        assert (r.samples, r.covered, r.longest_run, r.start_distance, r.end_distance, r.max_distance) == (len(d), sum(x <= 25.0 for x in d), max(runs), d[0], d[-1], ranked[-1])
        assert abs(r.median_distance - (ranked[half - 1] + ranked[len(d) - half]) / 2) < 6e-4 and r.p95_distance == ranked[max(1, -int(-len(d) * 0.95 // 1)) - 1]
