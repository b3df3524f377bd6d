"""Served rows, writers and small column functions."""

import json

from pyspark.sql import functions as F

from lodestone.functions.names import regex_ok
from lodestone.functions.numbers import approx_equal
from lodestone.operators import serving
from lodestone.sources import sinks
from lodestone.streaming import events


def test_toggle_turns_one_row(spark):
    df = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "id string, completed boolean")
    assert [(r.id, r.completed) for r in serving.toggle(df, "a").orderBy("id").collect()] == [("a", False), ("b", False), ("c", None)]
    assert [r.completed for r in serving.toggle(serving.toggle(df, "b"), "b").orderBy("id").collect()] == [True, False, None]


def test_filters_are_active_only_if_they_filter():
    assert not serving.filters_active() and not serving.filters_active(query="  ")
    assert serving.filters_active("East") and serving.filters_active(query="x") and serving.filters_active(completion="completed")


def test_a_role_sees_its_rows(spark):
    serving.role_view("own_notes", spark.createDataFrame([("u1", 1), ("u2", 2), (None, 3)], "user_id string, n int"), "user_id")
    see = lambda: [r.n for r in spark.sql("SELECT n FROM own_notes").collect()]
    assert see() == []
    spark.sql("SET VAR current_owner = 'u2'")
    assert see() == [2]


def test_numbers_and_patterns(spark):
    df = spark.sql("SELECT * FROM VALUES (1D, 1.0000005D), (1D, 1.1D), (double('NaN'), double('NaN')), (null, 1D), (double('Infinity'), double('Infinity')) t(a, b)")
    assert [r.x for r in df.select(approx_equal(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, False, False, False]
    df = spark.createDataFrame([("abc",), ("abcd",), ("A",), (None,)], "s string")
    assert [r.x for r in df.select(regex_ok(F.col("s"), "^[a-z]+$", 3).alias("x")).collect()] == [True, False, False, False]


def test_names_of_outputs_depend_on_inputs():
    demo = {"demo/a.json", "demo/b.json"}
    assert sinks.route(["demo/a.json", "demo/b.json"], demo, "out", "2026-01-02T03:04:05Z") == "out.demo"
    assert sinks.route(["demo/a.json", "mine.json"], demo, "out", "2026-01-02T03:04:05Z") == "out.local.20260102T030405Z"
    assert sinks.route([], demo, "out", "x") == "out.local.x"
    assert sinks.redacted("demo/a.json", demo) == "demo/a.json" and sinks.redacted("/Users/me/x", demo) == "private path omitted"


def test_stage_of_tables_and_of_none(spark, tmp_path):
    sinks.write_stage({"t": spark.range(3)}, str(tmp_path / "a"), {"generated_at": "then"})
    sinks.write_stage({}, str(tmp_path / "b"), {"generated_at": "then"})
    assert spark.read.parquet(str(tmp_path / "a/t")).count() == 3
    assert [spark.read.parquet(str(tmp_path / f"{x}/metadata")).collect()[0].generated_at for x in "ab"] == ["then", "then"]


def test_features_and_preview(spark):
    df = spark.sql("SELECT array(named_struct('lon', 1D, 'lat', 2D), named_struct('lon', 3D, 'lat', 4D)) AS line, 'n' AS name")
    f = json.loads(df.select(sinks.feature(F.col("line"), name=F.col("name")).alias("f")).collect()[0].f)
    assert f["geometry"] == {"type": "LineString", "coordinates": [[1.0, 2.0], [3.0, 4.0]]} and f["properties"] == {"name": "n"}
    points = spark.createDataFrame([(0.0, 10.0), (2.0, 20.0), (1.0, 15.0)], "lon double, lat double")
    assert [(r.x, r.y) for r in sinks.preview(points, 100.0, 50.0).collect()] == [(0.0, 50.0), (100.0, 0.0), (50.0, 25.0)]
    assert [(r.x, r.y) for r in sinks.preview(points.limit(1), 100.0, 50.0).collect()] == [(50.0, 25.0)]


def test_sessions_end_after_a_pause(spark):
    df = spark.sql("SELECT 'u' AS user_id, timestamp(t) AS ts FROM VALUES ('2026-01-01 10:00:00'), ('2026-01-01 10:20:00'), ('2026-01-01 11:00:00') v(t)")
    assert sorted(r.n for r in events.sessions(df).collect()) == [1, 2]
