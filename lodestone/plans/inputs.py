"""Roles that the supplied tables take: traces from events, lines from nations, names from parts, reviews from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import point
from ..functions.names import normalize_name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trace_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events in time order are a trace: steps of about 32 m, a jump at each error, a new component at each signup."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    n = lambda kind: F.count_if(F.col("event_type") == kind).over(w)
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    e = e.withColumn("rn", F.row_number().over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("er", n("error")).withColumn("comp", n("signup"))
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("activity_key"), F.col("comp").cast("int").alias("component_idx"), F.col("rn").cast("int").alias("point_idx"), (F.lit(-71.0) + 0.0004 * F.col("rn") + 0.002 * F.col("er")).alias("lon"), (F.lit(44.0) + 0.00022 * (F.col("user_id") % 5)).alias("lat"), F.col("ts").cast("string").alias("time"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation is a segment of about 400 m."""
    x, y = F.lit(-71.0) + 0.001 * F.col("n_nationkey"), F.lit(44.0) + 0.00022 * (F.col("n_nationkey") % 5)
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("segment_key"), F.array(point(x, y), point(x + 0.005, y)).alias("line"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part is a named feature."""
    x, y = F.col("p_size") * 0.01 - 72, F.col("p_retailprice") * 0.0001 + 43
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("Mt. "), F.col("p_name"), F.lit(" Trail")).alias("trail_name"), (F.col("p_size") / 8.0).alias("gis_miles"), x.alias("x1"), y.alias("y1"), (x + 0.02).alias("x2"), (y + 0.01).alias("y2"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part type and a name make an item whose name is close to some features' names."""
    name = F.concat(F.initcap(F.regexp_replace("p_name", "e", "")), F.lit(" Rd"))
    return table(spark, sf_dir, "part").select(F.concat_ws("|", "p_type", "p_name").alias("item_key"), normalize_name(name).alias("item_name")).distinct()


def served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as segments of the order's region, with miles and completion."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_partkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.col("o_orderpriority").alias("trail_name"), F.col("n_name").alias("segment_name"), F.col("r_name").alias("region"), F.col("l_quantity").alias("miles"), (F.col("l_returnflag") == "R").alias("completed"))


def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as decisions about users."""
    kind = F.when(F.col("event_type") == "purchase", "accepted").when(F.col("event_type") == "error", "rejected").otherwise("needs_review")
    return table(spark, sf_dir, "events").select(F.lit("segment").alias("target_type"), F.col("user_id").alias("target_key"), kind.alias("decision"), "ts", "event_id")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as candidate segments of the trail that their order is; a full ordering tells repeated keys apart."""
    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax")
    status = lambda c, yes, no: F.when(F.col(c) == yes, "verified_for_publication").when(F.col(c) == no, "rejected").otherwise("needs_review")
    li = li.select("l_orderkey", F.row_number().over(w).cast("long").alias("seq"), (F.col("l_quantity") / 16.0).alias("miles"), status("l_returnflag", "N", "R").alias("segment_decision"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", status("o_orderstatus", "F", "P").alias("trail_decision"), "o_orderpriority")
    return li.join(o, li.l_orderkey == o.o_orderkey, "left").drop("o_orderkey")
