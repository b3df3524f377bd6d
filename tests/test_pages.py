import json

from pyspark.sql import functions as F

from lodestone.sources import pages


def feature(i, x=0.0):
    return {"type": "Feature", "id": i, "properties": {"OBJECTID": i, "TRAIL_NAME": f"n{i}" if i % 2 else None, "GIS_MILES": 0.5}, "geometry": {"type": "LineString", "coordinates": [[x, 1.0], [x + 1, 2.0]]} if i != 3 else {"type": "Point", "coordinates": [0, 0]}}


def page(*ids, more=True, **extra):
    return json.dumps({"type": "FeatureCollection", "features": [feature(i, float(i)) for i in ids], "exceededTransferLimit": more, **extra})


def read(spark, *rows, **options):
    f, s, i = pages.paged_features(spark.createDataFrame(list(rows), "page_offset long, body string"), 2, **options)
    return [(r.source_index, r.id) for r in f.orderBy("source_index").collect()], [(r.source_index, r.reason) for r in s.collect()], sorted(r.message for r in i.collect())


def test_pages_up_to_the_short_one(spark):
    got = read(spark, (2, page(2, 3)), (0, page(0, 1)), (4, page(4)), (6, page(6, 7)))
    assert got == ([(1, "0"), (2, "1"), (3, "2"), (5, "4")], [(4, "Unsupported geometry")], [])


def test_a_full_page_without_more_ends_the_list(spark):
    assert read(spark, (0, page(0, 1, more=None)), (2, page(4, 5)))[0] == [(1, "0"), (2, "1")]


def test_box(spark):
    assert read(spark, (0, page(0, 1)), (2, page(4, more=False)), box=(1.5, 0.0, 3.0, 1.5))[0] == [(2, "1")]


def test_what_is_wrong_with_pages(spark):
    assert read(spark, (0, page(0, 1)), (4, page(4)))[2] == ["page_missing:2"]
    assert read(spark, (0, page(0, 1)), (0, page(0, 1)), (2, page()))[2] == ["page_repeated:0"]
    assert read(spark, (0, page(0, 1)), (2, "<html>"), (4, page(error={"code": 500})), (6, page()))[2] == ["page_unreadable:2", "page_unreadable:4"]
    assert read(spark, (0, page(0, 1)))[2] == ["list_without_end"]
    assert read(spark) == ([], [], ["list_without_end"])


def test_stored_pages_and_summary(spark, tmp_path):
    for k, body in ((0, page(0, 1)), (2, page(2, 3)), (4, page(5))):
        (tmp_path / f"page-{k}.json").write_text(body)
    f, s, i = pages.paged_features(pages.stored_pages(spark, str(tmp_path)), 2)
    assert i.count() == 0
    assert tuple(pages.staging_summary(f, s).first()) == (4, 2, 2, 2, 2.0, 1)


def test_collections_hold_all_features_in_order(spark, tmp_path):
    rows = spark.range(500).select(F.format_string("%04d", F.col("id")).alias("key"), F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("id"))).alias("feature"))
    pages.write_collections(rows.orderBy(F.rand(1)), str(tmp_path / "out"), 6)
    files = sorted((tmp_path / "out").glob("part-*"))
    docs = [json.loads(p.read_text()) for p in files if p.stat().st_size]
    assert [x["id"] for d in docs for x in d["features"]] == list(range(500)) and 2 <= len(docs) <= 6 and max(len(d["features"]) for d in docs) < 300
    pages.write_collections(rows.limit(0), str(tmp_path / "none"), 3)
    assert all(not p.read_text() for p in (tmp_path / "none").glob("part-*"))
