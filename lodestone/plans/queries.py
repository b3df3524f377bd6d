"""Operators applied to the supplied tables, by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, keys, names, nested
from ..functions.numbers import lenient_number, number_text, round_half_up
from ..operators import cleaning, decisions, history, issues, load, matching, network, publication, reconcile, serving, stages, topology, traces, workspace
from ..operators.graph import checkpoint
from ..operators.publication import VERIFIED
from ..sources import pages
from . import inputs as I  # noqa: E741

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def classify_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matching.match(I.trace_points(spark, sf_dir), I.segments(spark, sf_dir))
    return m.select("activity_key", "segment_key", "match_key", "classification", "samples", "covered", "coverage", "start_distance", "end_distance", "median_distance", "p95_distance", "max_distance", F.col("longest_run"), "gap_ratio", "best_coverage", "best_component", "strong_component", "ignored_edges", "blocked")


@query
def match_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = I.trace_points(spark, sf_dir), I.segments(spark, sf_dir)
    return matching.diagnostics(matching.match(p, s), p, s)


@query
def unmatched_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.trace_points(spark, sf_dir)
    return matching.unmatched(p, matching.match(p, I.segments(spark, sf_dir)))


@query
def component_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_component, _ = matching.component_evidence(I.trace_points(spark, sf_dir), I.segments(spark, sf_dir))
    return by_component.select("activity_key", "segment_key", "component_idx", "samples", "covered", "coverage", "start_distance", "end_distance", "median_distance", "p95_distance", "max_distance", "gap_ratio")


@query
def coverage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, by_pair = matching.component_evidence(I.trace_points(spark, sf_dir), I.segments(spark, sf_dir))
    place = lambda c, v: round_half_up(F.col(f"{c}.{v}"), 5).alias(f"{c}_{v}")
    return by_pair.select("activity_key", "segment_key", "covered", "coverage", "longest_run", place("first_matched", "lat"), place("last_matched", "lat"))


@query
def nearest_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = I.trace_points(spark, sf_dir), I.segments(spark, sf_dir)
    near = matching.found(p, s)
    alone = near.where("alone").select("activity_key", "segment_key", F.explode(F.arrays_zip("i", "least")).alias("x")).select("activity_key", "segment_key", "x.i", (F.col("x.least") / 1000.0).alias("distance"))
    return alone.unionByName(matching.least(near.where("not alone"))).withColumnRenamed("i", "sample_idx")


@query
def line_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.samples(I.segments(spark, sf_dir)).select("segment_key", F.col("sample_idx").cast("long").alias("sample_idx"), round_half_up(F.col("place.lon"), 6).alias("lon"), round_half_up(F.col("place.lat"), 6).alias("lat"))


@query
def bbox_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.pairs(I.trace_points(spark, sf_dir), I.segments(spark, sf_dir))


@query
def trace_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.gap_stats(I.trace_points(spark, sf_dir))


@query
def trusted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traces.trusted_lines(I.trace_points(spark, sf_dir))
    return t.groupBy("activity_key", "component_idx", F.col("line_idx").cast("long").alias("line_idx")).agg(F.count("*").alias("points"), round_half_up(F.coalesce(F.sum(F.when(F.col("gap") <= traces.LONGEST_EDGE, F.col("gap"))), F.lit(0.0)), 3).alias("metres"))


@query
def cumulative_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.measures(I.trace_points(spark, sf_dir)).select("activity_key", "component_idx", "point_idx", round_half_up(F.col("measure"), 3).alias("measure"))


@query
def dedupe_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.trace_points(spark, sf_dir)
    flat = p.withColumn("lon", F.lit(-71.0) + F.floor(F.col("point_idx") / 3) * 0.0004)
    return traces.drop_repeated_points(flat).select("activity_key", "component_idx", "point_idx")


@query
def longest_uncovered_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "view").alias("ok"))
    e = e.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return traces.longest_run(e, ["user_id"], "n", "ok")


@query
def activity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.activity_summary(I.trace_points(spark, sf_dir)).select("activities", "points")


@query
def activity_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activities, points, first and last time by text."""
    return traces.activity_summary(I.trace_points(spark, sf_dir))


@query
def activity_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.trace_points(spark, sf_dir)
    clean, counts = traces.clean_points(p)
    return counts.join(clean.groupBy("activity_key").agg(F.count("*").alias("kept_points")), "activity_key", "left").withColumn("kept_points", F.coalesce("kept_points", F.lit(0)))


@query
def haversine_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = I.segments(spark, sf_dir)
    return s.select("segment_key", round_half_up(geo.line_length(F.col("line")), 3).alias("metres"), geo.miles(geo.line_length(F.col("line"))).alias("miles"))


@query
def bbox_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = matching.activity_boxes(I.trace_points(spark, sf_dir))
    return b.select("activity_key", *[round_half_up(F.col(f"lbox.{c}"), 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query
def point_segment_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as points, their nation's segment as the edge."""
    c = I.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (F.lit(-71.0) + 0.00001 * (F.col("c_custkey") % 4000)).alias("x"), (F.lit(44.0) + 0.00001 * (F.col("c_custkey") % 97)).alias("y"))
    s = I.segments(spark, sf_dir).withColumn("k", F.substring("segment_key", 2, 9).cast("int"))
    d = c.join(s, c.c_nationkey == s.k).withColumn("d", geo.closest_on_edge(geo.point(F.col("x"), F.col("y")), F.col("line")[0], F.col("line")[1]))
    return d.select("c_custkey", round_half_up(F.col("d.distance"), 3).alias("distance"), round_half_up(F.col("d.ratio"), 6).alias("ratio"))


def _network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as lines eastward, regions as lines northward across them."""
    n = I.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("ord"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("item_key"), F.col("n_name").alias("normalized"), (F.lit(44.0) + 0.001 * F.col("n_nationkey")).alias("y"))
    n = n.select("ord", "item_key", "normalized", F.array("item_key").alias("ids"), F.array(F.array(geo.point(-71.0, F.col("y")), geo.point(-70.99, F.col("y")))).alias("components"))
    r = I.table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000).cast("long").alias("ord"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("item_key"), F.col("r_name").alias("normalized"), (F.lit(-70.9995) + 0.002 * F.col("r_regionkey")).alias("x"))
    r = r.select("ord", "item_key", "normalized", F.array("item_key").alias("ids"), F.array(F.array(geo.point(F.col("x"), 43.9995), geo.point(F.col("x"), 44.0245))).alias("components"))
    return n.unionByName(r)


@query
def segment_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = topology.working_lines(_network(spark, sf_dir))
    d = topology.detections(lines).where("reason = 'cross_trail_intersection'")
    return d.select(F.array_join("items", "|").alias("items"), round_half_up(F.col("place.lon"), 6).alias("lon"), round_half_up(F.col("place.lat"), 6).alias("lat"))


@query
def line_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = topology.build(_network(spark, sf_dir))
    return out["segments"].groupBy("item_key").agg(F.count("*").alias("segments"), round_half_up(F.sum("metres"), 1).alias("metres"))


@query
def topology_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = topology.build(_network(spark, sf_dir))
    return out["diagnostics"].select("sources", "lines", "junctions", "crossings", "segments", "near_misses").join(F.broadcast(out["issues"].agg(F.count("*").alias("issues"))))


@query
def endpoint_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that are within 12 m of a nation's line."""
    c = I.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("junction_key"), geo.point(F.lit(-71.0) + 0.00001 * (F.col("c_custkey") % 1000), F.lit(44.0) + 0.00001 * (F.col("c_custkey") % 2503)).alias("place"))
    e = topology.line_edges(topology.working_lines(_network(spark, sf_dir).where("ord < 1000")))
    near = topology.on_lines(c, e, 12.0)
    return near.join(topology.working_lines(_network(spark, sf_dir)).select("component_key", "item_key"), "component_key").select("junction_key", "item_key", round_half_up(F.col("gap"), 2).alias("gap"))


@query
def junction_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.trace_points(spark, sf_dir).withColumn("u", F.substring("activity_key", 2, 9).cast("long"))
    d = p.select(F.array(F.lit(0).cast("long"), F.col("u"), F.col("point_idx").cast("long")).alias("ord"), geo.point(F.col("lon"), F.lit(0.0) + 0.01 * F.col("u")).alias("place"), F.lit("trail_endpoint").alias("reason"), F.lit(None).cast("double").alias("gap"), F.array("activity_key").alias("items"), F.array("activity_key").alias("names"), F.array("activity_key").alias("ids"))
    c = topology.clusters(d, topology.Tolerances(junction_dedup=60.0, intersection=60.0))
    return c.groupBy(F.col("items")[0].alias("activity_key"), "cluster").agg(F.count("*").alias("n")).groupBy("activity_key").agg(F.count("*").alias("clusters"), F.max("n").alias("largest"))


@query
def component_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region is a source whose components are its nations' pieces, end to end where keys follow each other."""
    n = I.table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", (F.floor(F.col("n_nationkey") / 5)).cast("int").alias("k"))
    part = F.struct("k", F.array(geo.point(F.lit(-71.0) + 0.001 * F.col("k") + F.when(F.col("k") >= 3, 0.01).otherwise(0.0), F.lit(44.0)), geo.point(F.lit(-71.0) + 0.001 * (F.col("k") + 1) + F.when(F.col("k") >= 3, 0.01).otherwise(0.0), F.lit(44.0))).alias("line"))
    s = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(part)).alias("p")).select(F.col("n_regionkey").cast("long").alias("ord"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("item_key"), F.lit("R").alias("normalized"), F.array(F.lit("1")).alias("ids"), F.transform("p", lambda x: x["line"]).alias("components"))
    lines = topology.working_lines(s)
    return lines.select("item_key", F.col("component_idx").cast("long").alias("component_idx"), F.size("members").cast("long").alias("members"), F.size("line").cast("long").alias("points"), "disconnected")


@query
def chain_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer is a source of three parts, its triangle's sides in an order and direction that follow from its key; every third lacks a side."""
    c = F.col("c_custkey")
    corner = lambda k: geo.point(-71.0 + 0.001 * (c % 1000) + F.when(k == 1, 0.0004).when(k == 2, 0.0002).otherwise(0.0), F.when(k == 2, 44.0003).otherwise(44.0))

    def side(i: int) -> Column:
        k = (F.floor(c / 7) + i * (1 + c % 2)) % 3
        a, b = corner(k), corner((k + 1) % 3)
        return F.when((c + i) % 4 < 2, F.array(a, b)).otherwise(F.array(b, a))

    sides = F.array(side(0), side(1), side(2))
    s = I.table(spark, sf_dir, "customer").select(c.cast("long").alias("ord"), F.concat(F.lit("c"), c.cast("string")).alias("item_key"), F.lit("C").alias("normalized"), F.array(F.lit("1")).alias("ids"), F.when(c % 3 == 0, F.slice(sides, 1, 2)).otherwise(sides).alias("components"))
    told = F.transform("line", lambda p: F.concat_ws(":", F.round(p["lon"] * 10_000).cast("long").cast("string"), F.round(p["lat"] * 10_000).cast("long").cast("string")))
    return topology.working_lines(s).select("item_key", F.array_join(told, " ").alias("line"))


# names and reconciliation


@query
def name_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.table(spark, sf_dir, "part").select(F.concat(F.lit(" Mt. "), F.col("p_name"), F.lit(" & "), F.col("p_type"), F.lit("'s-Rd  TrAiL trail")).alias("name")).distinct()
    return p.select("name", names.normalize_name(F.col("name")).alias("normalized"))


@query
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.table(spark, sf_dir, "part").select("p_partkey", F.upper("p_name").alias("a"))
    q = p.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("a").alias("b"))
    return p.join(q, "p_partkey").select("p_partkey", round_half_up(names.similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query
def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.table(spark, sf_dir, "part").select("p_partkey", F.upper(F.concat_ws(" ", "p_name", "p_type")).alias("a"))
    q = p.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("a").alias("b"))
    return p.join(q, "p_partkey").select("p_partkey", round_half_up(names.token_overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


def _reconcile(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    items, groups = I.items(spark, sf_dir), reconcile.group_features(I.features(spark, sf_dir))
    return items, groups, reconcile.candidates(items, groups)


@query
def candidate_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.rank(_reconcile(spark, sf_dir)[2], 5)


@query
def candidate_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _, found = _reconcile(spark, sf_dir)
    return reconcile.classify(items, found)


@query
def reconcile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _, found = _reconcile(spark, sf_dir)
    return reconcile.summary(reconcile.classify(items, found))


@query
def referenced_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, groups, found = _reconcile(spark, sf_dir)
    return reconcile.referenced_groups(groups, found).select("normalized", "feature_count")


@query
def source_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = reconcile.group_features(I.features(spark, sf_dir))
    return g.select("normalized", "feature_count", "display_name", F.array_join("names", "|").alias("names"), F.array_join("ids", "|").alias("ids"), "gis_miles", *[round_half_up(F.col(c), 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query
def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.feature_summary(I.features(spark, sf_dir))


@query
def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key")).where("n > 1")


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.table(spark, sf_dir, "part")
    return p.select((F.col("p_partkey") + 2).alias("row_no"), F.when(F.col("p_partkey") % 50 == 7, "").otherwise(F.concat_ws("-", F.col("p_name"), F.col("p_size").cast("string"))).alias("item_key"), F.when(F.col("p_partkey") % 70 == 3, None).otherwise(F.col("p_name")).alias("name"), F.lit("").alias("region_hint"), F.lit("").alias("notes"))


@query
def inventory_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.validate_inventory(_inventory(spark, sf_dir))[1]


@query
def inventory_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the inventory that hold, each with its normalised name."""
    return cleaning.validate_inventory(_inventory(spark, sf_dir))[0].select(F.col("row_no").cast("long").alias("row_no"), "item_key", "name", "normalized")


@query
def inventory_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised names that several items of the inventory share."""
    return cleaning.validate_inventory(_inventory(spark, sf_dir))[2].select("normalized", "n", F.col("first_row").cast("long").alias("first_row"))


@query
def repeated_key_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues.duplicates(I.table(spark, sf_dir, "part").select("p_name", "p_type"), ["p_name", "p_type"], "duplicate_part")


@query
def unknown_key_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users that aren't among the customers of an even key."""
    known = I.table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"))
    return issues.unknown(I.table(spark, sf_dir, "events").select("user_id", "event_type"), known, ["user_id"], "unknown_user").groupBy("rule", "message").agg(F.count("*").alias("n"))


# serving


@query
def filter_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.filter_segments(I.served(spark, sf_dir), region="ASIA", query=" Urgent ", completion="completed").select("l_orderkey", "l_linenumber", "l_partkey", "miles")


@query
def available_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.regions(I.served(spark, sf_dir))


@query
def progress_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.progress(I.served(spark, sf_dir))


@query
def progress_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.progress(serving.filter_segments(I.served(spark, sf_dir), query="high"))


@query
def progress_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.progress(I.served(spark, sf_dir), "region")


@query
def api_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = I.table(spark, sf_dir, "lineitem")
    seg = li.select(F.col("l_orderkey").alias("trail_id"), "l_linenumber", "l_partkey", "l_quantity", F.when(F.col("l_linestatus") == "F", "verified").otherwise("unverified").alias("data_status"), F.when(F.col("l_returnflag") == "N", "human_verified").otherwise("raw_source").alias("verification_status"))
    o = I.table(spark, sf_dir, "orders")
    trail = o.select(F.col("o_orderkey").alias("trail_id"), F.concat(F.lit("t-"), F.col("o_orderkey").cast("string")).alias("slug"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("region"), F.when(F.col("o_orderstatus") != "P", "verified").otherwise("retired").alias("data_status"), F.lit("human_verified").alias("verification_status"))
    return serving.public_rows(seg, trail).select("trail_id", "l_linenumber", "l_partkey", "l_quantity", "trail_slug", "trail_name", "trail_region")


@query
def rls_own_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = I.table(spark, sf_dir, "orders")
    return serving.own_rows(o, F.lit(7), "o_custkey", F.col("o_orderstatus") == "P").select("o_orderkey", "o_custkey", "o_orderstatus")


@query
def policy_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = I.table(spark, sf_dir, "orders"), I.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return serving.visible_parents(o, li, "o_orderkey", (F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "N")).select("o_orderkey", "o_orderstatus")


@query
def top_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.page(I.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 100)


@query
def workspace_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.search(I.table(spark, sf_dir, "supplier"), "upplier#00000001", ["s_name", "s_nationkey"]).select("s_suppkey", "s_name")


# decisions


@query
def latest_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.latest(I.decision_log(spark, sf_dir), ["target_type", "target_key"], ["ts", "event_id"]).select("target_key", "decision", "event_id")


@query
def decision_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = I.decision_log(spark, sf_dir)
    old = decisions.latest(log.where(F.col("event_id") % 2 == 0), ["target_type", "target_key"], ["ts", "event_id"])
    new = decisions.latest(log.where((F.col("event_id") % 2 == 1) & (F.col("decision") != "needs_review")), ["target_type", "target_key"], ["ts", "event_id"])
    return decisions.override(old, new, ["target_type", "target_key"]).select("target_key", "decision", "event_id")


@query
def duplicate_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.repeated(I.decision_log(spark, sf_dir), ["target_key", "decision"], ["ts", "event_id"]).select("target_key", "event_id", "occurrence")


@query
def unknown_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = I.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target_key"))
    return c.join(I.decision_log(spark, sf_dir).select("target_key").distinct(), "target_key", "left_anti")


def _eligible(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = I.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("segment_key"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("start_key"), F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)).alias("end_key"))
    last = decisions.latest(I.decision_log(spark, sf_dir), ["target_type", "target_key"], ["ts", "event_id"])
    own = last.select(F.lit("segment").alias("target_type"), F.col("target_key").cast("string").alias("target_key"), "decision")
    start = last.select(F.lit("junction").alias("target_type"), F.concat(F.lit("c"), F.col("target_key").cast("string")).alias("target_key"), F.when(F.col("target_key") % 2 == 0, "accepted").otherwise(F.col("decision")).alias("decision"))
    end = I.table(spark, sf_dir, "region").select(F.lit("junction").alias("target_type"), F.concat(F.lit("p"), F.col("r_regionkey").cast("string")).alias("target_key"), F.lit("accepted").alias("decision"))
    return decisions.eligible_segments(o, own.unionByName(start).unionByName(end))


@query
def eligible_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _eligible(spark, sf_dir)[0].select("segment_key", "start_key", "end_key")


@query
def eligibility_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _eligible(spark, sf_dir)[1]


# publication


def _gate(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, published, issues): orders as trails, named by their priority; line items as their segments."""
    c = I.candidates(spark, sf_dir).withColumn("segment_key", F.concat_ws("-", "l_orderkey", "seq")).withColumn("candidate_trail_key", F.col("l_orderkey").cast("string"))
    end = lambda x, y: F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat"))
    rows = c.select("l_orderkey", "seq", "miles", "segment_key", "candidate_trail_key", F.col("o_orderpriority").alias("display_name"), F.array(end(F.lit(0), F.lit(0)), end(F.lit(0), F.col("miles") / 69)).alias("line"))
    own = c.select(F.lit("segment").alias("target_type"), F.col("segment_key").alias("target_key"), F.col("segment_decision").alias("decision"))
    trail = c.where("trail_decision is not null").select(F.lit("trail").alias("target_type"), F.col("candidate_trail_key").alias("target_key"), F.col("trail_decision").alias("decision")).distinct()
    return c, *publication.gate(rows, own.unionByName(trail))


@query
def gate_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gate(spark, sf_dir)[1].select("l_orderkey", "seq", "miles")


@query
def gate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, _, wrong = _gate(spark, sf_dir)
    keys_ = wrong.where("rule = 'trail_not_verified'").select(F.substring_index("message", ":", -1).alias("segment_key"))
    return c.join(keys_, "segment_key").groupBy("trail_decision").agg(F.count("*").alias("n"))


@query
def trail_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = I.candidates(spark, sf_dir).select(F.col("l_orderkey").alias("candidate_trail_key"), F.lpad(F.col("seq").cast("string"), 4, "0").alias("segment_key"), "miles", F.col("o_orderpriority").alias("display_name"), F.col("trail_decision").alias("region"), F.array("segment_decision").alias("ids"))
    r = publication.rollup(c)
    return r.select("candidate_trail_key", "segments", "miles", F.array_join("ids", "|").alias("ids"), F.array_join("segment_keys", "|").alias("segment_keys"))


@query
def publication_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = I.candidates(spark, sf_dir)
    n = lambda k: F.count_if(F.col("segment_decision") == k).alias(k)
    ok = (F.col("segment_decision") == VERIFIED) & F.coalesce(F.col("trail_decision") == VERIFIED, F.lit(False))
    return c.agg(n(VERIFIED), n("rejected"), n("needs_review"), F.count_if(ok).alias("published_segments"), F.count_distinct(F.when(ok, F.col("l_orderkey"))).alias("published_trails"), round_half_up(F.sum(F.when(ok, F.col("miles"))), 4).alias("published_miles"))


@query
def publication_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library's own diagnostics, over candidates, their decisions and what both decisions let through; every seventh candidate lacks a decision."""
    c = I.candidates(spark, sf_dir).withColumn("segment_key", F.concat_ws("-", "l_orderkey", "seq"))
    own = c.where("l_orderkey % 7 <> 0").select(F.lit("segment").alias("target_type"), F.col("segment_key").alias("target_key"), F.col("segment_decision").alias("decision"))
    rows = c.where((F.col("l_orderkey") % 7 != 0) & (F.col("segment_decision") == VERIFIED) & (F.col("trail_decision") == VERIFIED)).select(F.col("l_orderkey").alias("trail_key"), "miles")
    return publication.diagnostics(c.select("segment_key"), own, rows)


@query
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return publication.upsert(e.where("event_id % 3 = 0"), e.where("event_id % 3 <> 0"), ["user_id", "event_type"], ["event_id"])


@query
def conflict_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = I.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    new = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus"))).withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 13 == 0, None).otherwise(F.col("o_orderpriority")))
    return publication.conflicts(new, o, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query
def stable_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.table(spark, sf_dir, "part")
    name = names.normalize_name(F.col("p_name"))
    t = keys.candidate_trail_key(F.col("p_brand"), name)
    return p.select("p_partkey", keys.stable_key("junction", "segment-construction-v1", F.col("p_brand"), F.col("p_name")).alias("junction_key"), t.alias("candidate_key"), keys.trail_key(t).alias("trail_key"), keys.match_key(F.col("p_name"), F.col("p_brand")).alias("match_key"))


@query
def stable_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "supplier").select("s_suppkey", keys.stable_uuid(F.col("s_name")).alias("uuid"))


@query
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "part").select("p_partkey", names.slugify(F.concat(F.lit("  "), F.col("p_name"), F.lit(" / "), F.col("p_brand"), F.lit("!"))).alias("slug"), names.safe_filename(F.concat(F.lit("a/b\\"), F.col("p_name"), F.lit(".gpx"))).alias("file"))


@query
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = I.segments(spark, sf_dir)
    return s.select("segment_key", keys.line_fingerprint(F.col("line"), 6).alias("fingerprint"), F.sha2(keys.line_text(F.reverse("line"), 7), 256).alias("reverse_sha256"))


# open data


@query
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.table(spark, sf_dir, "events").withColumn("v", F.parse_json("props"))
    return e.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"), F.try_variant_get("v", "$.none", "string").isNull().alias("absent"))


@query
def coerce_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.table(spark, sf_dir, "part")
    raw = F.when(F.col("p_size") % 5 == 0, "").when(F.col("p_size") % 5 == 1, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".50 "))).when(F.col("p_size") % 5 == 2, F.col("p_name")).otherwise(F.col("p_size").cast("string"))
    return p.select("p_partkey", lenient_number(raw).alias("number"), number_text(F.col("p_retailprice") / 7, 3).alias("text"))


@query
def validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = I.table(spark, sf_dir, "customer")
    _, bad = cleaning.constraints(c, {"balance": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD"), "name": F.col("c_name").rlike("^Customer#[0-9]{9}$")})
    return bad.select("c_custkey", F.array_join("failed", ",").alias("failed"))


@query
def timestamp_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = I.table(spark, sf_dir, "orders")
    t = F.when(F.col("o_orderkey") % 7 == 0, "not a time").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z")))
    return o.select("o_orderkey", F.try_to_timestamp(t).isNotNull().alias("ok"))


@query
def redact_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = I.table(spark, sf_dir, "supplier")
    value = {"sourcePath": F.concat(F.lit("data/"), F.col("s_name")), "folder": F.concat(F.lit("b\\"), F.col("s_name")), "note": F.concat(F.lit("a/b "), F.col("s_name")), "home": F.concat(F.lit("/home/"), F.col("s_name")), "root": F.concat(F.lit("/data/"), F.col("s_name")), "profile": F.concat(F.lit("x/"), F.col("s_name")), "disk": F.concat(F.lit("C:\\x\\"), F.col("s_name"))}
    m = F.create_map(*[c for k, v in value.items() for c in (F.lit(k), v)])
    return s.select("s_suppkey", cleaning.redact_paths(m).alias("m")).select("s_suppkey", *[F.col("m")[k].alias(k) for k in value])


def _instant(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


@query
def decision_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = history.intervals(I.decision_log(spark, sf_dir), ["target_key"], "ts", "decision", ["event_id"])
    return d.select("target_key", "decision", _instant("valid_from").alias("valid_from"), _instant("valid_to").alias("valid_to"))


@query
def decision_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and clicks with the decision that is in force when they happen."""
    log = I.decision_log(spark, sf_dir)
    seen = I.table(spark, sf_dir, "events").where("event_type in ('view', 'click')").select("event_id", F.col("user_id").alias("target_key"), "ts")
    made = log.where("decision <> 'needs_review'").select("target_key", "ts", "decision", F.col("event_id").alias("made"))
    return history.as_of(seen, made, ["target_key"], "ts", "decision", ["made"]).select("event_id", "target_key", "decision")


@query
def updated_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order changes when it is made and when a line of it ships."""
    o = I.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("at"))
    li = I.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_shipdate").alias("at"))
    return history.updated_at(["key"], (o, "at"), (li, "at")).select("key", F.date_format("updated_at", "yyyy-MM-dd").alias("updated_at"))


@query
def user_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as activities, their lines as matches with parts, a part for each customer as entered by hand."""
    a = I.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("activity_key"), F.col("o_custkey").alias("user_id"), F.to_date("o_orderdate").alias("completed_on"))
    m = I.table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("activity_key"), F.col("l_partkey").alias("segment_key"), (1 - F.col("l_discount")).alias("match_confidence"))
    c = I.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 200).alias("segment_key"), F.to_date(F.lit("1997-06-01")).alias("completed_on"), F.when(F.col("c_nationkey") % 5 == 0, "admin").when(F.col("c_nationkey") % 5 == 1, "unknown").otherwise("manual").alias("completion_method"))
    done = history.completions(a, m, c)
    return done.select("user_id", "segment_key", "activity_key", F.date_format("completed_on", "yyyy-MM-dd").alias("completed_on"), "completion_method", "match_confidence")


@query
def load_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a load does with orders as trails: two in three are there, some under another name or region."""
    o = I.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trail_key"), F.col("o_orderpriority").alias("slug"), F.col("o_orderstatus").alias("name"), F.col("o_custkey").cast("string").alias("region"))
    there = o.where("trail_key % 3 <> 0").withColumns({"name": F.when(F.col("trail_key") % 11 == 0, "X").otherwise(F.col("name")), "region": F.when(F.col("trail_key") % 13 == 0, None).otherwise(F.col("region"))})
    return load.plan(there, o, "trail_key", load.TRAIL_IDENTITY)


@query
def load_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as trails and parts as segments of them; some lines run the other way, some moved, some trails are unknown."""
    s = I.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("trail_key"), F.lit("a").alias("slug"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("region"))
    line = lambda move: F.array(geo.point(F.lit(-71.0), 44 + F.col("p_size") * 0.01), geo.point(F.lit(-71.1) + move, 44 + F.col("p_size") * 0.01))
    p = I.table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("production_key"), (F.col("p_partkey") % 12).cast("string").alias("trail_key"), F.col("p_name").alias("segment_name"), line(F.lit(0.0)).alias("line"), line(F.lit(0.01)).alias("moved"))
    there = p.select("production_key", "trail_key", "segment_name", F.when(F.col("p_partkey") % 7 == 0, F.col("moved")).when(F.col("p_partkey") % 2 == 0, F.reverse("line")).otherwise(F.col("line")).alias("line"))
    old = s.withColumn("region", F.when(F.col("trail_key").cast("int") % 9 == 4, "none").otherwise(F.col("region")))
    return load.refusals(s, p, old, there)


def _documents_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event's props put into a deeper document, with paths of its own."""
    u = F.col("user_id").cast("string")
    inner = F.concat(F.lit('{"z": ['), F.col("props"), F.lit(', {"file": ["/home/u'), u, F.lit('", "a/b", "plain"]}], "importFolder": "data/'), u, F.lit('", "a": {"note": "a/b", "deep": [[{"p": "C:\\\\\\\\x\\\\\\\\'), u, F.lit('"}]]}, "n": 1.50}'))
    return I.table(spark, sf_dir, "events").select("event_id", inner.alias("doc"))


@query
def redact_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents_of_events(spark, sf_dir).select("event_id", nested.redact_json(F.col("doc")).alias("doc"))


@query
def stable_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the hash of their stable text, which is that of the same document with its keys in another order."""
    d = I.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"b": '), F.col("props"), F.lit(', "a": [1.0, 1e3]}')).alias("p"), F.concat(F.lit('{"a":[1,1000],"b":'), F.col("props"), F.lit("}")).alias("q"))
    return d.select("event_id", F.sha2(nested.stable_text(F.col("p")), 256).alias("sha256"), nested.json_equal(F.col("p"), F.col("q")).alias("same"))


@query
def json_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = nested.elements(_documents_of_events(spark, sf_dir), "doc", "$.z[1].file")
    return d.select("event_id", F.col("pos").cast("long").alias("pos"), "element", nested.build_object(id=F.col("event_id"), pos=F.col("pos"), none=F.lit(None).cast("string")).alias("object"))


def _line_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as matches of the order with a part."""
    kind = F.when(F.col("l_returnflag") == "R", "insufficient_coverage").when(F.col("l_linestatus") == "F", "candidate").otherwise("strong_candidate")
    return I.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("activity_key"), F.col("l_partkey").alias("segment_key"), kind.alias("classification"))


@query
def visible_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _line_matches(spark, sf_dir)
    shown = [workspace.visible_matches(m, s).withColumn("shown", F.lit(s)) for s in ("matched_segments", "unmatched_activities", "candidate")]
    return issues.every(*shown).groupBy("shown", "activity_key").agg(F.count("*").alias("n"))


@query
def visible_publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as segments, decided on by size, and anew by a user for some."""
    p = I.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("segment_key"), "p_size")
    said = lambda c: p.where(c).select(F.lit("segment").alias("target_type"), F.col("segment_key").alias("target_key"), "p_size")
    committed = said("p_size > 10").select("target_type", "target_key", F.when(F.col("p_size") > 30, VERIFIED).otherwise("rejected").alias("decision"))
    local = said("p_size % 4 = 0").select("target_type", "target_key", F.when(F.col("p_size") % 8 == 0, "needs_review").otherwise(VERIFIED).alias("decision"))
    return workspace.visible_publication(p.select("segment_key"), committed, local, "verified")


@query
def decode_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rows of the API: some without good coordinates, some without provenance."""
    k = F.col("p_partkey")
    t = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    coordinates = F.when(k % 7 == 0, '[[1, 2], ["3", 4]]').when(k % 7 == 1, "[[1, 2]]").otherwise(t("[[-71, ", F.col("p_size"), "], [-71.5, 44.25, 900]]"))
    provenance = F.when(k % 3 == 0, F.lit(None)).when(k % 3 == 1, '{"provider": "OSM", "dataset": 5, "manuallyModified": 1}').otherwise(t('{"provider": "', F.col("p_brand"), '", "dataset": "', F.col("p_brand"), '", "reviewedAt": "2024-01-01"}'))
    none = F.lit(None).cast("string")
    raw = I.table(spark, sf_dir, "part").select(k.cast("string").alias("id"), F.col("p_name").alias("slug"), none.alias("trail_id"), F.col("p_type").alias("trail_name"), F.col("p_name").alias("segment_name"), F.col("p_brand").alias("trail_region"), t(" ", F.col("p_size"), ".5 ").alias("miles"), coordinates.alias("coordinates"), provenance.alias("provenance"), t('["a', k, '", ', k, ', "b"]').alias("source_feature_ids"), F.col("p_type").alias("source_label"), none.alias("source_ref"), F.when(k % 5 == 0, F.lit(True)).alias("geometry_manually_modified"), none.alias("reviewed_at"))
    d = workspace.decode_rows(raw)
    return d.select("id", "region", "miles", F.col("coordinates")[0][1].alias("y1"), F.col("coordinates")[1][1].alias("y2"), F.size(F.col("coordinates")[1]).cast("long").alias("width"), "provider", "dataset", F.array_join("source_feature_ids", ",").alias("ids"), "manually_modified", "reviewed_at")


@query
def error_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.table(spark, sf_dir, "events")
    text = F.when(F.col("event_type") == "error", "Duplicate KEY value").when(F.col("event_type") == "signup", "violates profiles_username_format_chk").otherwise(F.col("event_type"))
    return e.select("event_id", workspace.safe_error(text).alias("shown"))


@query
def default_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = I.table(spark, sf_dir, "customer")
    full = F.when(F.col("c_nationkey") % 3 == 0, " ").when(F.col("c_nationkey") % 3 == 1, F.concat(F.lit("  "), F.repeat("c_name", 9)))
    return c.select("c_custkey", workspace.default_name(full, F.col("c_mktsegment")).alias("display_name"))


def _before(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Points and segments of an earlier day: some users are missing, some have fewer points, a nation is missing and some lie elsewhere."""
    user = F.substring("activity_key", 2, 20).cast("long")
    p = I.trace_points(spark, sf_dir).where((user % 13 != 5) & ~((user % 11 == 3) & (F.col("point_idx") > 3)))
    s = I.segments(spark, sf_dir).where("segment_key <> 's3'")
    away = F.transform("line", lambda p: geo.point(p["lon"] + 0.002, p["lat"]))
    return p, s.withColumn("line", F.when(F.col("segment_key").isin("s4", "s9"), away).otherwise(F.col("line")))


@query
def stage_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = _before(spark, sf_dir)
    a = stages.changes(stages.activity_prints(p), stages.activity_prints(I.trace_points(spark, sf_dir)), "activity_key")
    b = stages.changes(stages.segment_prints(s), stages.segment_prints(I.segments(spark, sf_dir)), "segment_key")
    return a.withColumnRenamed("activity_key", "key").unionByName(b.withColumnRenamed("segment_key", "key"))


@query
def incremental_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches of now from those of an earlier day and what changed since."""
    old_p, old_s = _before(spark, sf_dir)
    p, s = I.trace_points(spark, sf_dir), I.segments(spark, sf_dir)
    a = checkpoint(stages.changes(stages.activity_prints(old_p), stages.activity_prints(p), "activity_key"))
    b = checkpoint(stages.changes(stages.segment_prints(old_s), stages.segment_prints(s), "segment_key"))
    m = stages.rematch(p, s, checkpoint(matching.match(old_p, old_s)), a, b)
    return m.select("activity_key", "segment_key", "match_key", "classification", "samples", "covered", "coverage")


@query
def match_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as matches of every second order with parts, whose decisions come from their size; issues by rule."""
    a = I.table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("activity_key"))
    said = lambda n: F.when(F.col("p_size") % n != 0, "accepted")
    s = I.table(spark, sf_dir, "part").where("p_partkey % 5 <> 0").select(F.col("p_partkey").cast("string").alias("segment_key"), said(7).alias("segment_decision"), said(11).alias("start_decision"), said(13).alias("end_decision"), F.when(F.col("p_size") < 45, keys.SEGMENT_VERSION).alias("construction_version"))
    m = I.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("activity_key"), F.col("l_partkey").cast("string").alias("segment_key"))
    return matching.reference_issues(m, a, s, keys.MATCH_VERSION).groupBy("rule", "message").agg(F.count("*").alias("n"))


def _pages(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """Parts as features, in pages of ``size`` bodies; every 17th is a point."""
    t = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    k, x = F.col("p_partkey"), F.col("p_size")
    shape = F.when(k % 17 == 0, '{"type": "Point", "coordinates": [1, 2]}').otherwise(t('{"type": "LineString", "coordinates": [[', x, ", 44], [", x + 1, ", 45.5]]}"))
    body = t('{"id": ', k, ', "properties": {"objectid": ', k, ', "trail_name": "', F.when(k % 5 == 0, " ").otherwise(F.col("p_name")), '", "gis_miles": ', x, '}, "geometry": ', shape, "}")
    p = I.table(spark, sf_dir, "part").select(F.expr(f"p_partkey div {size} * {size}").alias("page_offset"), F.struct(k.alias("k"), body.alias("f")).alias("x"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda y: y["f"]), ",")
    return p.groupBy("page_offset").agg(t('{"features": [', listed, '], "exceededTransferLimit": true}').alias("body"))


@query
def paged_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, _, _ = pages.paged_features(_pages(spark, sf_dir, 48), 48, (10.0, 40.0, 30.5, 50.0))
    return f.select(F.col("source_index").cast("long").alias("source_index"), "id", "trail_name", "gis_miles", "x1", "y2")


@query
def staging_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, s, _ = pages.paged_features(_pages(spark, sf_dir, 48), 48)
    return pages.staging_summary(f, s)


def damage() -> list[tuple[str, str, Column]]:
    """(rule that must fire, column, damaged value): number k of the list hits segments whose key has remainder k by 64."""
    p = F.col("provenance")
    inside = lambda part, field, to: ("provenance", p.withField(part, p[part].withField(field, to)))
    return [
        ("segment_data_status", "data_status", F.lit("demo")),
        ("segment_verification_status", "verification_status", F.lit("raw_source")),
        ("segment_completed", "completed", F.lit(True)),
        ("segment_trail_trail_name", "trail_name", F.lit("another")),
        ("segment_trail_region", "region", F.lit("Sandwich Range")),
        ("segment_candidate_provider", "provider", F.lit("another")),
        ("segment_candidate_ids", "ids", F.array(F.lit("0"))),
        ("segment_candidate_miles", "miles", F.col("miles") + 0.5),
        ("segment_candidate_line", "line", F.reverse("line")),
        ("segment_production_key_unstable", "production_key", F.concat("production_key", F.lit("0"))),
        ("segment_provenance_item_key", "provenance", p.withField("item_key", F.lit("another"))),
        ("segment_provenance_start_key", "provenance", p.withField("start_key", F.lit("another"))),
        ("segment_provenance_end_key", "provenance", p.withField("end_key", F.lit(None).cast("string"))),
        ("segment_provenance_version", "provenance", p.withField("version", F.lit("old"))),
        ("segment_provenance_lineage", "provenance", p.withField("lineage", F.lit("{}"))),
        ("segment_source_metres", *inside("source", "metres", p["source"]["metres"] + 1)),
        ("segment_source_modification", *inside("source", "modification", F.lit("moved"))),
        ("segment_decision_differs", *inside("decision", "notes", F.lit("changed"))),
        ("segment_trail_decision_differs", *inside("trail_decision", "notes", F.lit("changed"))),
        ("segment_upstream_start_not_accepted", *inside("upstream", "start", p["upstream"]["start"].withField("decision", F.lit("rejected")))),
        ("segment_upstream_end_target", *inside("upstream", "end", p["upstream"]["end"].withField("target_key", F.lit("another")))),
    ]


def clean_network(spark: SparkSession, sf_dir: str) -> network.Network:
    """Parts as verified segments, four to a trail, with nothing wrong; the segments are cut from their lineage."""
    artifact = F.struct(F.lit("2024-01-01T00:00:00Z").alias("generated_at"), F.lit(True).alias("demo_only"), F.lit(keys.SEGMENT_VERSION).alias("algorithm_version"))
    # a small file that one task would read grows to wide rows with keys to be hashed: its rows are dealt out first
    dealt = I.table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    p = dealt.select(
        F.col("p_partkey").cast("string").alias("segment_key"),
        F.concat(F.lit("item"), F.floor(F.col("p_partkey") / 4)).alias("item_key"),
        F.lit("ridge").alias("normalized"),
        F.lit("Ridge").alias("display_name"),
        F.lit("survey").alias("provider"),
        F.array(F.col("p_partkey").cast("string"), F.lit("s")).alias("ids"),
        F.concat(F.lit("a"), F.col("p_partkey")).alias("start_key"),
        F.concat(F.lit("b"), F.col("p_partkey")).alias("end_key"),
        F.array(geo.point(F.lit(-71.0), 44 + F.col("p_size") * 0.01), geo.point(-71.1 - F.col("p_partkey") * 1e-7, 44 + F.col("p_size") * 0.01)).alias("line"),
        (F.col("p_size") * 0.25).alias("miles"),
        (F.col("p_size") * 0.25 * 1609.344).alias("metres"),
        F.to_json(F.struct(F.col("p_brand").alias("brand"))).alias("lineage"),
        F.lit("none").alias("modification"),
    )
    p = p.withColumn("candidate_trail_key", keys.candidate_trail_key(F.col("item_key"), F.col("normalized"))).withColumn("trail_key", keys.trail_key(F.col("candidate_trail_key")))
    built = ("segment_key", "display_name", "item_key", "normalized", "provider", "ids", "start_key", "end_key", "line", "miles", "metres", "lineage", "modification")
    p = p.withColumns({"artifact": artifact, "source": F.struct(*built), "version": F.lit(keys.SEGMENT_VERSION), "region": F.lit("Other")})
    p = checkpoint(p)
    decision = lambda kind, key: F.struct(F.lit(kind).alias("target_type"), F.col(key).alias("target_key"), F.lit(VERIFIED).alias("decision"), F.lit("2024-02-01T00:00:00Z").alias("review_timestamp"), F.lit(None).cast("string").alias("notes"))
    trail = checkpoint(p.groupBy("candidate_trail_key", "trail_key", "item_key", "normalized", "display_name", "provider", "region").agg(F.sort_array(F.flatten(F.collect_list("ids"))).alias("ids"), F.sort_array(F.collect_list("segment_key")).alias("segment_keys"), F.sum("miles").alias("miles")))
    accepted = lambda kind, key, name: F.struct(F.lit(kind).alias("target_type"), F.col(key).alias("target_key"), F.lit("accepted").alias("decision")).alias(name)
    own = F.struct("segment_key", "candidate_trail_key", "item_key", "start_key", "end_key", "version", "artifact", "source", "lineage", decision("segment", "segment_key").alias("decision"), decision("trail", "candidate_trail_key").alias("trail_decision"), F.struct(accepted("segment", "segment_key", "segment"), accepted("junction", "start_key", "start"), accepted("junction", "end_key", "end")).alias("upstream"))
    status = [F.lit("verified").alias("data_status"), F.lit("human_verified").alias("verification_status")]
    header = spark.range(1).select(F.lit(network.NETWORK_VERSION).alias("algorithm_version"), F.lit(keys.TRAIL_KEY_VERSION).alias("trail_key_version"), F.lit(keys.SEGMENT_KEY_VERSION).alias("segment_key_version"), F.lit(True).alias("demo_only"), artifact.alias("source"), artifact.alias("decision_source"))
    return network.Network(
        header,
        trail.drop("trail_key"),
        p.drop("trail_key", "region"),
        trail.select("candidate_trail_key", "display_name", "region"),
        p.select(decision("segment", "segment_key").alias("d")).unionByName(trail.select(decision("trail", "candidate_trail_key").alias("d"))).select("d.*"),
        trail.select(keys.stable_uuid(F.col("trail_key")).alias("trail_id"), "trail_key", F.concat(F.lit("ridge-"), "trail_key").alias("slug"), F.col("display_name").alias("name"), "region", "normalized", *status, "ids", "miles", F.struct("candidate_trail_key", "item_key", "provider", "segment_keys", decision("trail", "candidate_trail_key").alias("decision")).alias("provenance")),
        checkpoint(p.select(F.col("segment_key").alias("segment_id"), publication.segment_key(F.col("trail_key"), F.col("line")).alias("production_key"), F.concat(F.lit("ridge-"), "segment_key").alias("slug"), keys.stable_uuid(F.col("trail_key")).alias("trail_id"), "trail_key", F.col("display_name").alias("trail_name"), "region", *status, F.lit(False).alias("completed"), "provider", "ids", "line", "miles", own.alias("provenance"))),
    )


@query
def network_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as published segments, a third of them damaged in one place each."""
    n = clean_network(spark, sf_dir)
    changed: dict[str, Column] = {}
    for k, (_, column, to) in enumerate(damage()):
        changed[column] = changed.get(column, F).when(F.col("segment_id").cast("bigint") % 64 == k, to)
    # one choice a column, so that no damage nests in another
    return network.network_issues(replace(n, segments=n.segments.withColumns({c: x.otherwise(F.col(c)) for c, x in changed.items()})))


@query
def guarded_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stored match decisions; by the key's remainder one is unreadable, has a number for a text, a null note or an unknown decision."""
    k, text = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    note = F.when(k % 5 == 0, ',"notes":null').when(k % 5 == 1, ',"notes":"seen"').otherwise("")
    key = F.when(k % 7 == 0, text).otherwise(F.concat(F.lit('"a'), text, F.lit('"')))
    decision = F.when(k % 3 == 0, "accepted").when(k % 11 == 0, "verified_for_publication").otherwise("needs_review")
    one = F.concat(F.lit('{"activityKey":'), key, F.lit(',"segmentKey":"s","matchKey":"m","reviewTimestamp":"t","activityMatchingAlgorithmVersion":"v","segmentConstructionAlgorithmVersion":"v","decision":"'), decision, F.lit('"'), note, F.lit("}"))
    raw = I.table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("[1,"), one, F.when(k % 13 == 0, "").otherwise("]")).alias("raw"))
    return decisions.guarded(raw, "match").select("o_orderkey", "activityKey", "decision", "notes")
