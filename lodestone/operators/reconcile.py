"""Reconciliation: source features are grouped by name, matched with inventory items, scored, ranked and classified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import AMBIGUOUS_GAP, EXACT_RUNNER_UP, LEAST_SCORE, normalize_name, score_columns, squeeze, tokens
from ..functions.numbers import round_half_up

#: Below these no pair reaches the least score: similarity 0.593 or overlap 0.636 before any bonus.
LENGTH_RATIO = 0.593


def natural_sort(ids: Column) -> Column:
    """Numbers by value first, then the rest by code point; repeats stay."""
    keyed = F.transform(ids, lambda v: F.struct(v.try_cast("bigint").isNull().alias("text"), v.try_cast("bigint").alias("number"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda s: s["v"])


def group_features(features: DataFrame) -> DataFrame:
    """One row per normalised name: display name, names, ids, number, miles, box.

    Features are (id, trail_name, gis_miles, x1, y1, x2, y2). Rows whose name is blank, or blank once normalised, go.
    """
    named = features.withColumn("normalized", normalize_name(F.col("trail_name"))).where(F.length(F.trim("trail_name")) > 0).where(F.length("normalized") > 0)
    clean = squeeze(F.col("trail_name"))
    return named.groupBy("normalized").agg(
        F.count("*").alias("feature_count"),
        F.min(clean).alias("display_name"),
        F.array_sort(F.collect_set(clean)).alias("names"),
        natural_sort(F.collect_list(F.col("id").cast("string"))).alias("ids"),
        round_half_up(F.sum(F.coalesce("gis_miles", F.lit(0.0))), 6).alias("gis_miles"),
        F.min("x1").alias("x1"),
        F.min("y1").alias("y1"),
        F.max("x2").alias("x2"),
        F.max("y2").alias("y2"),
    )


def feature_summary(features: DataFrame) -> DataFrame:
    """One row: numbers of features, named ones, distinct trimmed names, and sums of lengths."""
    name = F.nullif(F.trim("trail_name"), F.lit(""))
    return features.agg(F.count("*").alias("features"), F.count(name).alias("named"), F.count_distinct(name).alias("unique_names"), round_half_up(F.sum(F.coalesce("gis_miles", F.lit(0.0))), 3).alias("gis_miles"))


def candidates(items: DataFrame, groups: DataFrame) -> DataFrame:
    """item_key, item_name, normalized, similarity, overlap, score of pairs that score LEAST_SCORE or more.

    Items are (item_key, item_name), both sides have normalised names. No pair reaches the score unless the names
    share a token or their lengths are in a ratio of LENGTH_RATIO or more, so two equi-joins find all pairs: one on
    tokens, one on lengths. Names are joined once per distinct name; items come back by their name at the end.
    """
    names = items.select("item_name").distinct()
    targets = groups.select("normalized").distinct()
    by_token = names.withColumn("t", F.explode(tokens(F.col("item_name")))).join(targets.withColumn("t", F.explode(tokens(F.col("normalized")))), "t")
    n = F.length("item_name")
    lengths = F.sequence(F.greatest(F.lit(1), F.ceil(n * LENGTH_RATIO).cast("int")), F.greatest(F.lit(1), F.floor(n / LENGTH_RATIO).cast("int")))
    by_length = names.withColumn("n", F.explode(lengths)).join(targets.withColumn("n", F.length("normalized")), "n")
    pairs = by_token.select("item_name", "normalized").unionByName(by_length.select("item_name", "normalized")).distinct()
    scored = pairs.withColumns(score_columns(F.col("item_name"), F.col("normalized"))).where(F.col("score") >= LEAST_SCORE)
    return items.join(scored, "item_name").select("item_key", "item_name", "normalized", "similarity", "overlap", "score")


def rank(found: DataFrame, most: int | None = None) -> DataFrame:
    """Candidates of each item with their place: best score first, then name."""
    w = Window.partitionBy("item_key").orderBy(F.desc("score"), "normalized")
    ranked = found.withColumn("place", F.row_number().over(w).cast("long"))
    return ranked if most is None else ranked.where(F.col("place") <= most)


def classify(items: DataFrame, found: DataFrame) -> DataFrame:
    """item_key, n_candidates, top_score, second_score, status for every item, matched or not."""
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "normalized")))
    per = rank(found, 2).groupBy("item_key").agg(best.alias("b"))
    n = found.groupBy("item_key").agg(F.count("*").alias("n"))
    both = items.select("item_key").join(per, "item_key", "left").join(n, "item_key", "left")
    top, second = -F.try_element_at("b", F.lit(1))["s"], -F.try_element_at("b", F.lit(2))["s"]
    status = (
        F.when(F.col("n").isNull(), "unmatched")
        .when((top == 100) & (F.coalesce(second, F.lit(0)) < EXACT_RUNNER_UP), "exact")
        .when((F.col("n") >= 2) & (top - second < AMBIGUOUS_GAP), "ambiguous")
        .otherwise("needs_review")
    )
    return both.select("item_key", F.coalesce("n", F.lit(0)).alias("n_candidates"), F.try_element_at("b", F.lit(1))["normalized"].alias("top_name"), top.alias("top_score"), second.alias("second_score"), status.alias("status"))


def summary(classified: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return classified.agg(F.count("*").alias("items"), *[n(s) for s in ("exact", "ambiguous", "needs_review", "unmatched")], F.count_if(F.col("status") != "unmatched").alias("candidate_found"))


def referenced_groups(groups: DataFrame, found: DataFrame) -> DataFrame:
    return groups.join(found.select("normalized").distinct(), "normalized", "left_semi")


def accepted_sources(decisions: DataFrame, items: DataFrame, found: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted sources, issues) of decisions (item_key, selected, selected_ids, decision).

    An accepted decision must name an item, one of its candidates, its group, and exactly the group's ids. Where
    ``found`` carries the ids that a candidate was found with, they must be the group's too.
    """
    same = lambda a, b: F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))
    candidate_ids = F.col("ids") if "ids" in found.columns else F.lit(None).cast("array<string>")
    d = (
        decisions.where("decision = 'accepted'")
        .join(items.select("item_key", F.lit(True).alias("has_item")), "item_key", "left")
        .join(found.select("item_key", F.col("normalized").alias("selected"), F.lit(True).alias("has_candidate"), candidate_ids.alias("candidate_ids")), ["item_key", "selected"], "left")
        .join(groups.select(F.col("normalized").alias("selected"), "display_name", "ids"), "selected", "left")
    )
    about = F.col("item_key").cast("string")
    wrong = (
        F.when(F.col("has_item").isNull(), F.concat(F.lit("item not found:"), about))
        .when(F.coalesce(F.trim("selected"), F.lit("")) == "", F.concat(F.lit("candidate name required:"), about))
        .when(F.col("has_candidate").isNull(), F.concat(F.lit("candidate not found:"), about))
        .when(F.col("ids").isNull(), F.concat(F.lit("group not found:"), about))
        .when(F.col("candidate_ids").isNotNull() & ~same(F.col("candidate_ids"), F.col("ids")), F.concat(F.lit("candidate and group ids disagree:"), about))
        .when(~same(F.col("ids"), F.col("selected_ids")), F.concat(F.lit("selected ids must match exactly:"), about))
    )
    d = d.withColumn("wrong", wrong)
    return d.where("wrong is null").select("item_key", F.col("selected").alias("normalized"), "display_name", "ids"), d.where("wrong is not null").select(F.lit("accepted_source").alias("rule"), F.col("wrong").alias("message"))
