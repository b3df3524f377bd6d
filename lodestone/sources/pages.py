"""Answers of a paged feature service, and collections of features written as files of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import round_half_up
from ..operators.issues import duplicates, every
from .files import FEATURES, decode_features

Box = tuple[float, float, float, float]  # west, south, east, north


def stored_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_offset, body of files whose names end in the offset before their suffix, as page-2000.json."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.\w+$", 1).try_cast("long").alias("page_offset"), F.col("value").alias("body"))


def paged_features(pages: DataFrame, page_size: int, box: Box | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(features, skipped, issues) of pages (page_offset, body).

    The list ends with the first page that has fewer than ``page_size`` features or doesn't say that there are more;
    pages after it are not read. source_index is the place in the whole list, from 1. Features whose box doesn't meet
    ``box`` go. Issues are pages that are missing, repeated, errors or without a list of features, and a list without an end.
    """
    head = f"struct<features:{FEATURES},exceededTransferLimit:boolean,error:string>"
    read = pages.select("page_offset", F.from_json("body", head).alias("b"))
    n = F.coalesce(F.size("b.features"), F.lit(0))
    fine = F.col("b.features").isNotNull() & F.col("b.error").isNull()
    meta = read.select("page_offset", fine.alias("fine"), (fine & ((n < page_size) | ~F.coalesce("b.exceededTransferLimit", F.lit(False)))).alias("ends"))
    end = F.broadcast(meta.agg(F.min(F.when(F.col("ends"), F.col("page_offset"))).alias("last")))
    within = F.col("last").isNull() | (F.col("page_offset") <= F.col("last"))
    kept, known = read.join(end).where(within), meta.join(end).where(within)
    found = kept.where(fine).select("page_offset", F.posexplode("b.features").alias("place", "f"))
    features, skipped = decode_features(found.select((F.col("page_offset") + F.col("place") + 1).alias("source_index"), "f"))
    if box is not None:
        west, south, east, north = box
        features = features.where((F.col("x1") <= east) & (F.col("x2") >= west) & (F.col("y1") <= north) & (F.col("y2") >= south))
    wrong = lambda rows, rule: rows.select(F.lit(rule).alias("rule"), F.concat(F.lit(f"{rule}:"), F.col("page_offset").cast("string")).alias("message"))
    most = known.agg(F.max("page_offset").alias("most"))
    due = most.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("most"), F.lit(page_size).cast("long"))).alias("page_offset"))
    endless = meta.agg(F.count_if("ends").alias("ends")).where("ends = 0").select(F.lit("list_without_end").alias("rule"), F.lit("list_without_end").alias("message"))
    return features, skipped, every(wrong(due.join(known, "page_offset", "left_anti"), "page_missing"), duplicates(known, ["page_offset"], "page_repeated"), wrong(known.where(~F.col("fine")), "page_unreadable"), endless)


def staging_summary(features: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row: features, named ones, unnamed ones, distinct names, miles and skipped ones."""
    a = features.agg(F.count("*").alias("features"), F.count("trail_name").alias("named"), F.count_if(F.col("trail_name").isNull()).alias("unnamed"), F.count_distinct("trail_name").alias("unique_names"), round_half_up(F.coalesce(F.sum("gis_miles"), F.lit(0.0)), 3).alias("gis_miles"))
    return a.join(F.broadcast(skipped.agg(F.count("*").alias("skipped"))))


def _collection(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lines of one file; a partition without features writes none."""
    begun = False
    for batch in rows:
        if len(batch):
            yield pd.DataFrame({"value": (["," if begun else '{"type":"FeatureCollection","features":['] + [x for f in batch["feature"] for x in (f, ",")][:-1])})
            begun = True
    if begun:
        yield pd.DataFrame({"value": ["]}"]})


def write_collections(features: DataFrame, path: str, files: int) -> None:
    """Files of GeoJSON below ``path``, each a FeatureCollection of its own, in the order of ``key``.

    ``features`` is (key, feature as JSON text). Rows are dealt to about ``files`` ranges of keys and streamed, so no task
    holds a file. Spark's committer moves a file into place when its task is done; a lost task writes it again.
    """
    dealt = features.where("key is not null and feature is not null").repartitionByRange(files, "key").sortWithinPartitions("key", "feature")
    dealt.select("feature").mapInPandas(_collection, "value string").write.mode("overwrite").text(path)
