import json

import pytest
from pyspark.sql import functions as F

from lodestone.sources import files, sinks
from lodestone.streaming import events as E


def put(path, text):
    path.write_text(text)
    return str(path)


def test_inventory_csv(spark, tmp_path):
    p = put(tmp_path / "a.csv", 'item_key,name,region_hint,notes\none,"Mount ""T"", Trail",,\n,,,\ntwo,Mt Tecumseh,x,"y\nz"\n')
    got = files.inventory_csv(spark, p).orderBy("row_no").collect()
    assert [(r.row_no, r.item_key, r.name) for r in got] == [(2, "one", 'Mount "T", Trail'), (3, "two", "Mt Tecumseh")]
    with pytest.raises(ValueError, match="Missing required column: item_key"):
        files.inventory_csv(spark, put(tmp_path / "b.csv", "name\nx\n"))


def test_geojson_skips_other_geometries(spark, tmp_path):
    def feature(i, kind, coordinates, **properties):
        return {"type": "Feature", "id": i, "properties": {"objectid": i, **properties}, "geometry": {"type": kind, "coordinates": coordinates}}

    doc = {"type": "FeatureCollection", "features": [feature(1, "LineString", [[-71, 44], [-71.1, 44.1]], trail_name="A", gis_miles=1.1), feature(2, "MultiLineString", [[[-71, 44], [-71.1, 44.1]]], trail_name="B", gis_miles="2.25"), feature(3, "Polygon", [[[0, 0], [1, 1], [0, 1]]])]}
    good, bad = files.geojson_features(spark, put(tmp_path / "f.json", json.dumps(doc, indent=1)))
    assert good.count() == 2 and bad.count() == 1


GPX = """<gpx><metadata><name>walk</name></metadata><trk><name>t</name>
<trkseg><trkpt lon="-71" lat="44"><time>2024-01-01T00:00:00Z</time></trkpt><trkpt lon="-71.001" lat="44"/></trkseg>
<trkseg><trkpt lon="-71.01" lat="44"/><trkpt lon="-71.011" lat="44"/><trkpt lon="200" lat="44"/></trkseg></trk></gpx>"""


def test_gpx_and_json_activities(spark, tmp_path):
    put(tmp_path / "a.gpx", GPX)
    put(tmp_path / "b.json", json.dumps({"activities": [{"source": "s", "sourceActivityId": "1", "title": "x", "trace": {"type": "LineString", "coordinates": [[-71, 44], [-71.1, 44]]}}]}, indent=1))
    gpx = files.trace_points(files.gpx_activities(spark, f"{tmp_path}/*.gpx"))
    assert sorted(r["count"] for r in gpx.groupBy("component_idx").count().collect()) == [2, 2]
    assert files.trace_points(files.json_activities(spark, f"{tmp_path}/*.json")).count() == 2
    both = files.activity_folder(spark, str(tmp_path))
    assert both.count() == 2 and both.select("activity_key").distinct().count() == 2


def test_tables_are_upserted(spark, tmp_path):
    p = f"{tmp_path}/t"
    rows = lambda *x: spark.createDataFrame(x, "k int, seq int, v string")
    assert sinks.upsert_table(rows((1, 1, "a"), (2, 1, "b")), p, ["k"], ["seq"]) == 2
    assert sinks.upsert_table(rows((2, 2, "c"), (3, 1, "d")), p, ["k"], ["seq"]) == 2
    assert sorted(map(tuple, spark.read.parquet(p).collect())) == [(1, 1, "a"), (2, 2, "c"), (3, 1, "d")]


def test_stages_and_features_are_written(spark, tmp_path):
    sinks.write_stage({"x": spark.range(3)}, str(tmp_path), {"generated_at": "now"})
    assert spark.read.parquet(f"{tmp_path}/x").count() == 3
    assert spark.read.parquet(f"{tmp_path}/metadata").first().generated_at == "now"
    line = F.array(F.struct(F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat")))
    got = json.loads(spark.range(1).select(sinks.feature(line, name=F.lit("n")).alias("f")).first().f)
    assert got["geometry"]["coordinates"] == [[1.0, 2.0]] and got["properties"] == {"name": "n"}


def stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))


def test_windowed_stream_counts_what_the_batch_counts(spark, sf):
    q = E.windowed(stream(spark, sf)).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = E.windowed(spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted((r.window.start, r.event_type, r.n) for r in spark.table("windows").collect()) == sorted((r.window.start, r.event_type, r.n) for r in batch.collect())


def test_stream_is_upserted(spark, sf, tmp_path):
    E.upsert_stream(stream(spark, sf).select("user_id", "event_id", "value"), f"{tmp_path}/t", ["user_id"], ["event_id"], f"{tmp_path}/c").awaitTermination(120)
    last = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/t").select("user_id", "event_id").collect())) == sorted(map(tuple, last.collect()))
