"""Served views: filters, search, progress, public rows and row-level security."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round_half_up


def filter_segments(df: DataFrame, region: str | None = None, query: str = "", completion: str = "all") -> DataFrame:
    """Rows of (trail_name, segment_name, region, completed) that pass all three filters; a blank query passes everything."""
    q = query.strip().lower()
    if region is not None:
        df = df.where(F.col("region") == region)
    if completion != "all":
        df = df.where(F.col("completed") if completion == "completed" else ~F.col("completed"))
    if q:
        hit: Column = F.lit(False)
        for c in ("trail_name", "segment_name", "region"):
            hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(q))
        df = df.where(hit)
    return df


def filters_active(region: str | None = None, query: str = "", completion: str = "all") -> bool:
    return region is not None or bool(query.strip()) or completion != "all"


def regions(df: DataFrame) -> DataFrame:
    return df.where("region is not null").select("region").distinct()


def progress(df: DataFrame, *by: str) -> DataFrame:
    """Miles and numbers of segments, all and completed, and percentages; 0 where there is nothing."""
    done = F.col("completed")
    total, part = F.coalesce(F.sum("miles"), F.lit(0.0)), F.coalesce(F.sum(F.when(done, F.col("miles"))), F.lit(0.0))
    n, m = F.count("*"), F.count_if(done)
    share = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(round_half_up(100.0 * a / b, 3))
    out = [round_half_up(total, 3).alias("total_miles"), round_half_up(part, 3).alias("completed_miles"), n.alias("segments"), m.alias("completed_segments"), share(part, total).alias("miles_percent"), share(m, n).alias("segments_percent")]
    return (df.groupBy(*by) if by else df).agg(*out)


def toggle(df: DataFrame, segment_id: str) -> DataFrame:
    return df.withColumn("completed", F.when(F.col("id") == segment_id, ~F.col("completed")).otherwise(F.col("completed")))


def public_rows(segments: DataFrame, trails: DataFrame) -> DataFrame:
    """Segments joined with their trails where both are verified by a person."""
    ok = "data_status = 'verified' and verification_status = 'human_verified'"
    t = trails.where(ok).select("trail_id", F.col("slug").alias("trail_slug"), F.col("name").alias("trail_name"), F.col("region").alias("trail_region"))
    return segments.where(ok).join(t, "trail_id")


def visible_parents(parents: DataFrame, children: DataFrame, on: str, condition: Column) -> DataFrame:
    """Parents that have a child of the kind: EXISTS as a left semi-join."""
    return parents.join(children.where(condition), on, "left_semi")


def own_rows(df: DataFrame, user: Column, owner: str = "user_id", public: Column | None = None) -> DataFrame:
    """Row-level security: rows of the user, and public ones if given."""
    mine = F.col(owner) == user
    return df.where(mine if public is None else mine | public)


def role_view(name: str, df: DataFrame, owner: str) -> None:
    """A temporary view of the rows of the session variable ``current_owner``, read anew by every query."""
    spark = df.sparkSession
    spark.sql(f"DECLARE OR REPLACE VARIABLE current_owner {df.schema[owner].dataType.simpleString()}")
    df.createOrReplaceTempView(f"{name}_all")
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} AS SELECT * FROM {name}_all WHERE {owner} = session.current_owner")


def search(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    q = text.strip().lower()
    return df if not q else df.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(q)))


def page(df: DataFrame, order: list[str], size: int) -> DataFrame:
    return df.orderBy(*order).limit(size)


def public_profile(df: DataFrame) -> DataFrame:
    """Profiles with no user name or a valid one, of 3 to 32 characters, and a display name that is not too long."""
    valid = F.col("username").isNull() | F.col("username").rlike("^[a-z0-9][a-z0-9_-]{2,31}$")
    return df.where(valid & (F.length(F.coalesce("display_name", F.lit(""))) <= 120))
