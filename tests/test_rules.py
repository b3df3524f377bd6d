"""Rules of finished tables, each seen firing."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions.keys import MATCH_VERSION, SEGMENT_VERSION
from lodestone.operators import matching, topology
from lodestone.operators.issues import dealt, unknown

SEGMENT = "segment_key string, segment_decision string, start_decision string, end_decision string, construction_version string"
OK = ("accepted", "accepted", "accepted", SEGMENT_VERSION)


@pytest.mark.parametrize(
    "matches, activities, segments, version, want",
    [
        ([("a", "s")], [("a",)], [("s", *OK)], MATCH_VERSION, []),
        ([("b", "s")], [("a",)], [("s", *OK)], MATCH_VERSION, ["unknown_activity:b"]),
        ([("a", "t")], [("a",)], [("s", *OK)], MATCH_VERSION, ["unknown_segment:t"]),
        ([("a", "s")] * 2, [("a",)] * 2, [("s", *OK)] * 2, MATCH_VERSION, ["duplicate_activity:a", "duplicate_pair:a|s", "duplicate_segment:s"]),
        ([], [], [("s", "rejected", None, "needs_review", "old")], None, ["construction_version:s", "end_junction_not_accepted:s", "match_version", "segment_not_accepted:s", "start_junction_not_accepted:s"]),
    ],
)
def test_matches_against_what_they_refer_to(spark, matches, activities, segments, version, want):
    tables = (spark.createDataFrame(matches, "activity_key string, segment_key string"), spark.createDataFrame(activities, "activity_key string"), spark.createDataFrame(segments, SEGMENT))
    assert sorted(r.message for r in matching.reference_issues(*tables, version).collect()) == want


def test_large_tables_are_dealt_by_rows_and_stay_so_below_a_join(spark):
    df = spark.range(100).selectExpr("id % 7 AS k")
    (by_key,), (whole,) = dealt(df, ["k"], rows=10), dealt(df, ["k"])
    assert by_key.rdd.getNumPartitions() == 11 and whole is df
    found = unknown(by_key, spark.range(5).withColumnRenamed("id", "k"), ["k"], "r")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("RepartitionByExpression")
    assert sorted(r.message for r in found.collect()) == ["r:5"] * 14 + ["r:6"] * 14


def test_unknown_keys_may_be_null(spark):
    df = spark.createDataFrame([("a", 1), (None, 1), ("b", None)], "x string, y int")
    assert sorted(r.message for r in unknown(df, spark.createDataFrame([("a", 1), ("b", None)], "x string, y int"), ["x", "y"], "r").collect()) == ["r:1", "r:b"]


@pytest.fixture(scope="module")
def built(spark):
    line = lambda *p: [[(float(x), float(y)) for x, y in p]]
    sources = spark.createDataFrame([(0, "a", "a", ["1"], line((0, 0), (0.002, 0))), (1, "b", "b", ["2"], line((0.001, -0.001), (0.001, 0.001)))], topology.SOURCES)
    return sources, topology.build(sources)


def fired(sources, t):
    return {r.rule for r in topology.integrity(sources, t["lines"], t["junctions"], t["segments"], t["diagnostics"]).collect()}


def test_every_topology_rule_fires(built):
    sources, t = built
    assert fired(sources, t) == set()
    s, j, lines = t["segments"], t["junctions"], t["lines"]
    away = F.transform("line", lambda p: F.struct((p["lon"] + 0.01).alias("lon"), p["lat"].alias("lat")))
    with_ = lambda **x: fired(sources, {**t, **x})
    assert "duplicate_junction_key" in with_(junctions=j.unionByName(j.limit(1)))
    assert "duplicate_segment_key" in with_(segments=s.unionByName(s.limit(1)))
    assert "segment_missing_junction" in with_(segments=s.withColumn("start_key", F.lit("gone")))
    assert {"segment_start_not_at_junction", "segment_end_not_at_junction"} <= with_(segments=s.withColumn("line", away))
    assert "segment_non_positive_length" in with_(segments=s.withColumn("metres", F.lit(0.0)))
    assert "segment_untraceable_source_id" in with_(segments=s.withColumn("ids", F.array(F.lit("9"))))
    assert "input_component_not_accounted_for" in with_(segments=s.where("item_key = 'a'"))
    assert "length_delta_exceeds_epsilon_meters" in with_(diagnostics=t["diagnostics"].withColumn("delta_metres", F.lit(1e6)))
    whole = s.where("item_key = 'a'").groupBy("item_key").agg(*[F.min_by(c, "start_measure").alias(c) for c in ("segment_key", "normalized", "start_key", "ids", "component_idx", "component_key")], F.max_by("end_key", "start_measure").alias("end_key"), F.sum("metres").alias("metres"))
    whole = whole.join(lines.select("component_key", "line"), "component_key")
    assert "segment_contains_unsplit_junction" in with_(segments=whole)
