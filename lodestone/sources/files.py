"""Readers: inventory CSV, GeoJSON features, GPX and JSON activities, folders, stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import LINE, bbox
from ..functions.keys import activity_key
from ..functions.names import first_text, safe_filename
from ..functions.numbers import lenient_number

#: Features of a collection; properties and coordinates stay JSON text.
FEATURES = "array<struct<id:string,properties:string,geometry:struct<type:string,coordinates:string>>>"
INVENTORY = "item_key string, name string, region_hint string, notes string"
GPX = "struct<metadata:struct<name:string>,trk:array<struct<name:string,trkseg:array<struct<trkpt:array<struct<_lon:string,_lat:string,ele:string,time:string>>>>>>>"


def inventory_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows with row_no (the header is row 1); quotes, doubled quotes and line breaks in cells; blank rows go.

    Missing columns raise, as every later step needs them. Row numbers follow the order in the file, so a file is
    read as one piece; inventories are typed by people.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    have = {c.strip().lower(): c for c in raw.columns}
    missing = [c for c in ("item_key", "name") if c not in have]
    if missing:
        raise ValueError(f"Missing required column: {missing[0]}")
    cols = [F.col(f"`{have[c]}`").alias(c) if c in have else F.lit(None).cast("string").alias(c) for c in ("item_key", "name", "region_hint", "notes")]
    rows = raw.select(*cols, F.monotonically_increasing_id().alias("_n")).where(F.length(F.concat_ws("", "item_key", "name", "region_hint", "notes")) > 0)
    return rows.withColumn("row_no", F.row_number().over(Window.orderBy("_n")) + 1).drop("_n")


def geojson_features(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(features with components and box, skipped with the reason): lines with two numeric points or more in every part."""
    text = spark.read.text(path, wholetext=True)
    found = text.select(F.posexplode(F.from_json("value", f"struct<features:{FEATURES}>")["features"]).alias("source_index", "f"))
    return decode_features(found.withColumn("source_index", F.col("source_index") + 1))


def decode_features(f: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``geojson_features`` of rows (source_index, f), f being an element of FEATURES."""
    one, many = F.from_json(F.col("f.geometry.coordinates"), "array<array<double>>"), F.from_json(F.col("f.geometry.coordinates"), "array<array<array<double>>>")
    kind = F.col("f.geometry.type")
    parts = F.when(kind == "LineString", F.array(one)).when(kind == "MultiLineString", many)
    p = F.col("f.properties")
    prop = lambda n: F.coalesce(F.get_json_object(p, f"$.{n}"), F.get_json_object(p, f"$.{n.upper()}"))
    sound = F.coalesce((F.size("parts") > 0) & F.forall("parts", lambda c: (F.size(c) >= 2) & F.forall(c, lambda q: (F.size(q) >= 2) & q[0].isNotNull() & q[1].isNotNull())), F.lit(False))
    reason = F.when(~F.coalesce(kind.isin("LineString", "MultiLineString"), F.lit(False)), "Unsupported geometry").when(~sound, "Invalid coordinates")
    rows = f.select("source_index", first_text(prop("objectid"), F.col("f.id")).alias("id"), first_text(prop("trail_name")).alias("trail_name"), lenient_number(prop("segment_length")).alias("segment_length"), lenient_number(prop("gis_miles")).alias("gis_miles"), F.col("f.properties").alias("properties"), parts.alias("parts"), F.col("f"), kind.alias("kind")).withColumn("reason", reason)
    line = F.transform("parts", lambda c: F.transform(c, lambda q: F.struct(q[0].alias("lon"), q[1].alias("lat"))))
    good = rows.where("reason is null").withColumn("components", line).withColumn("box", bbox(F.flatten("components")))
    return good.select("source_index", "id", "trail_name", "segment_length", "gis_miles", "properties", "components", "box.x1", "box.y1", "box.x2", "box.y2"), rows.where("reason is not null").select("source_index", "id", "kind", "reason")


def _activities(rows: DataFrame) -> DataFrame:
    """Keys for (file, source, source_id, title, start, components, points)."""
    valid = F.transform("components", lambda c: F.filter(c, lambda p: F.coalesce(p["lon"].between(-180, 180) & p["lat"].between(-90, 90), F.lit(False))))
    kept = F.filter(valid, lambda c: F.size(c) >= 2)
    n = F.aggregate(F.transform("components", F.size), F.lit(0), lambda a, x: a + x)
    m = F.aggregate(F.transform("kept", F.size), F.lit(0), lambda a, x: a + x)
    rows = rows.withColumn("kept", kept).withColumn("original_points", n).withColumn("malformed_points", F.col("original_points") - m)
    plain = F.transform("kept", lambda c: F.transform(c, lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))))
    return rows.withColumn("activity_key", activity_key(F.col("source"), F.col("source_id"), F.col("start"), plain)).drop("components").withColumnRenamed("kept", "components")


def gpx_activities(spark: SparkSession, path: str) -> DataFrame:
    """One activity per file: a component for each track segment that has two valid points."""
    text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    x = text.withColumn("g", F.from_xml("value", GPX))
    segs = F.flatten(F.transform("g.trk", lambda t: F.coalesce(t["trkseg"], F.array().cast("array<struct<trkpt:array<struct<_lon:string,_lat:string,ele:string,time:string>>>>"))))
    point = lambda p: F.struct(lenient_number(p["_lon"]).alias("lon"), lenient_number(p["_lat"]).alias("lat"), lenient_number(p["ele"]).alias("ele"), p["time"].alias("time"))
    comps = F.transform(segs, lambda s: F.transform(F.coalesce(s["trkpt"], F.array().cast("array<struct<_lon:string,_lat:string,ele:string,time:string>>")), point))
    title = first_text(F.col("g.metadata.name"), F.try_element_at("g.trk", F.lit(1))["name"])
    start = F.array_min(F.filter(F.transform(F.flatten(comps), lambda p: p["time"]), lambda t: t.isNotNull()))
    return _activities(x.select(safe_filename(F.col("file")).alias("file"), F.lit("gpx").alias("source"), F.lit(None).cast("string").alias("source_id"), title.alias("title"), start.alias("start"), comps.alias("components")))


def json_activities(spark: SparkSession, path: str) -> DataFrame:
    """Activities of documents that are an array, an object with ``activities``, or one activity."""
    text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    many = F.coalesce(F.from_json(F.get_json_object("value", "$.activities"), "array<string>"), F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<string>")), F.array("value"))
    a = text.select("file", F.explode(many).alias("a"))
    get = lambda *names: first_text(*[F.get_json_object("a", f"$.{n}") for n in names])
    trace = F.coalesce(F.get_json_object("a", "$.trace"), F.get_json_object("a", "$.geometry"))
    kind, c = F.get_json_object(trace, "$.type"), F.get_json_object(trace, "$.coordinates")
    parts = F.when(kind == "LineString", F.array(F.from_json(c, "array<array<double>>"))).when(kind == "MultiLineString", F.from_json(c, "array<array<array<double>>>"))
    # null coordinates read as 0, as a lenient number does
    comps = F.transform(F.coalesce(parts, F.array().cast("array<array<array<double>>>")), lambda line: F.transform(line, lambda q: F.struct(F.when(F.size(q) >= 2, F.coalesce(q[0], F.lit(0.0))).alias("lon"), F.when(F.size(q) >= 2, F.coalesce(q[1], F.lit(0.0))).alias("lat"), F.get(q, 2).alias("ele"), F.lit(None).cast("string").alias("time"))))
    return _activities(a.select(safe_filename(F.col("file")).alias("file"), F.coalesce(get("source"), F.lit("normalized_json")).alias("source"), get("sourceActivityId").alias("source_id"), get("title", "name").alias("title"), get("startTime", "activityDate").alias("start"), comps.alias("components")))


def activity_folder(spark: SparkSession, path: str) -> DataFrame:
    """All activities of a folder's gpx, json and geojson files."""
    def some(glob: str, read) -> DataFrame | None:
        found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
        return None if found.limit(1).isEmpty() else read(spark, f"{path}/{glob}")

    parts = [d for d in (some("*.gpx", gpx_activities), some("*.json", json_activities), some("*.geojson", json_activities)) if d is not None]
    out = parts[0] if parts else json_activities(spark, path).limit(0)
    for d in parts[1:]:
        out = out.unionByName(d)
    return out


def trace_points(activities: DataFrame) -> DataFrame:
    """activity_key, component_idx, point_idx, lon, lat, time, ele."""
    c = activities.select("activity_key", F.posexplode("components").alias("component_idx", "c"))
    return c.select("activity_key", "component_idx", F.posexplode("c").alias("point_idx", "p")).select("activity_key", "component_idx", "point_idx", "p.lon", "p.lat", "p.time", "p.ele")


def stage(spark: SparkSession, root: str, table: str, schema: str) -> DataFrame:
    """A stage table; columns that the schema asks for must be there."""
    df = spark.read.parquet(f"{root}/{table}")
    want = spark.createDataFrame([], schema).columns
    if missing := [c for c in want if c not in df.columns]:
        raise ValueError(f"{table} lacks {', '.join(missing)}")
    return df.select(want)


__all__ = ["INVENTORY", "LINE", "activity_folder", "decode_features", "geojson_features", "gpx_activities", "inventory_csv", "json_activities", "stage", "trace_points"]
