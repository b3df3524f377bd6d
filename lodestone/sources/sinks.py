"""Writers: stage tables, routed paths, GeoJSON and upserted tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.publication import upsert


def route(inputs: list[str], demo: set[str], stem: str, stamp: str) -> str:
    """The demo name only if every input is a known demo path; else a local name with a time stamp."""
    return f"{stem}.demo" if inputs and all(p in demo for p in inputs) else f"{stem}.local.{re.sub('[^0-9A-Za-z]', '', stamp)}"


def redacted(path: str, demo: set[str]) -> str:
    return path if path in demo else "private path omitted"


def write_stage(tables: dict[str, DataFrame], root: str, metadata: dict[str, str]) -> None:
    """A folder of Parquet tables, and a table of one row of metadata; generated_at is given, never read from a clock."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
    SparkSession.active().createDataFrame([tuple(metadata.values())], ", ".join(f"{k} string" for k in metadata)).coalesce(1).write.mode("overwrite").parquet(f"{root}/metadata")


def feature(line: Column, **properties: Column) -> Column:
    """A GeoJSON feature as text."""
    geometry = F.struct(F.lit("LineString").alias("type"), F.transform(line, lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*[c.alias(k) for k, c in sorted(properties.items())]).alias("properties")))


def preview(points: DataFrame, width: float, height: float) -> DataFrame:
    """Points scaled into a picture, north up."""
    box = points.agg(F.min("lon").alias("x1"), F.max("lon").alias("x2"), F.min("lat").alias("y1"), F.max("lat").alias("y2"))
    p = points.join(F.broadcast(box))
    at = lambda v, lo, hi, size: F.when(F.col(hi) == F.col(lo), F.lit(size / 2)).otherwise((F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo)) * size)
    return p.withColumn("x", at("lon", "x1", "x2", width)).withColumn("y", height - at("lat", "y1", "y2", height)).drop("x1", "x2", "y1", "y2")


def upsert_table(incoming: DataFrame, path: str, keys: list[str], order: list[str]) -> int:
    """Put rows into the Parquet table at ``path``, the last of each key; returns the number of incoming rows.

    The new table is written beside the old one, which steps aside to ``path``.old before the new one takes its
    place. A run that is lost between the two leaves the old table there, and the next run puts it back first.
    """
    spark = incoming.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    here, new, aside = (jvm.org.apache.hadoop.fs.Path(f"{path}{end}") for end in ("", ".new", ".old"))
    fs = here.getFileSystem(conf)
    if not fs.exists(here) and fs.exists(aside):
        fs.rename(aside, here)
    n, known = incoming.count(), fs.exists(here)
    old = spark.read.parquet(path) if known else incoming.limit(0)
    upsert(old, incoming, keys, order).write.mode("overwrite").parquet(f"{path}.new")
    fs.delete(aside, True)
    if known:
        fs.rename(here, aside)
    fs.rename(new, here)
    fs.delete(aside, True)
    return n
