"""Incremental matching: base and delta give what matching everything gives."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import matching, stages
from lodestone.plans import inputs as I  # noqa: E741


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def world(spark, sf):
    return I.trace_points(spark, sf).where("activity_key < 'u14'").cache(), I.segments(spark, sf).where("segment_key < 's15'").cache()


def test_base_and_delta_equal_a_full_run(spark, world, tmp_path):
    points, segments = world
    moved = F.transform("line", lambda p: F.struct((p["lon"] + 0.001).alias("lon"), p["lat"].alias("lat")))
    old_points = points.where("activity_key <> 'u10' and not (activity_key = 'u11' and point_idx > 4)").unionByName(points.where("activity_key = 'u12'").withColumn("activity_key", F.lit("gone")))
    old_segments = segments.where("segment_key <> 's1'").withColumn("line", F.when(F.col("segment_key") == "s10", moved).otherwise(F.col("line")))
    stage = stages.MatchStage(spark, str(tmp_path / "stage"))
    stage.run(old_points, old_segments, "t0")
    assert rows(stage.read("matches")) == rows(matching.match(old_points, old_segments))
    n = stage.run(points, segments, "t1")
    assert n == {"activities": 3, "segments": 2}
    assert rows(stage.read("matches")) == rows(matching.match(points, segments))
    before = stage.version()
    assert stage.run(points, segments, "t2") == {"activities": 0, "segments": 0} and stage.version() == before
    assert stage.read("run").first().generated_at == "t1"


def test_prints_follow_content_and_not_order(spark):
    p = spark.createDataFrame([("a", 0, 0, 1.0, 2.0), ("a", 0, 1, 1.1, 2.0), ("b", 0, 0, 1.1, 2.0), ("b", 0, 1, 1.0, 2.0)], "activity_key string, component_idx int, point_idx int, lon double, lat double")
    one, two = ({r.activity_key: r.print for r in stages.activity_prints(x).collect()} for x in (p, p.orderBy(F.desc("lon"))))
    assert one == two and one["a"] != one["b"]


def test_changes(spark):
    t = "k string, print string"
    got = stages.changes(spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], t), spark.createDataFrame([("b", "1"), ("c", "2"), ("d", "1")], t), "k")
    assert {r.k: r.change for r in got.collect()} == {"a": "removed", "c": "changed", "d": "added"}


def test_what_changed_is_matched_in_one_pass_over_its_pairs_alone(spark, world, monkeypatch):
    points, segments = world
    seen, whole = [], matching.match(points, segments)
    keep = lambda p, s, config, pair=None: seen.append(pair) or whole.limit(0)
    monkeypatch.setattr(stages, "match", keep)
    a, s = (spark.createDataFrame([(k, "changed")], f"{c} string, change string") for c, k in (("activity_key", "u10"), ("segment_key", "s1")))
    stages.rematch(points, segments, whole.limit(0), a, s)
    (pair,) = seen
    want = {(r.activity_key, r.segment_key) for r in matching.pairs(points, segments).where("activity_key = 'u10' or segment_key = 's1'").collect()}
    got = [tuple(r) for r in pair.collect()]
    assert want and set(got) == want and len(got) == len(want)
