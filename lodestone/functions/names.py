"""Names: normalising, tokens, similarity and the score of a candidate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import round_half_up

#: Abbreviations that normalising spells out.
TOKENS = {"MT": "MOUNT", "MTN": "MOUNTAIN", "RD": "ROAD"}
#: Fixed values of the score: weights, bonuses and what they take, and the least score of a candidate.
SIMILARITY_WEIGHT, OVERLAP_WEIGHT = 75.0, 70.0
SIMILARITY_BONUS, SIMILARITY_FROM, OVERLAP_BONUS, OVERLAP_FROM = 15.0, 0.82, 10.0, 0.66
LEAST_SCORE, EXACT_RUNNER_UP, AMBIGUOUS_GAP = 45, 90, 12


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_name(c: Column) -> Column:
    """Upper case, & spelled out, punctuation gone, abbreviations spelled out, trailing TRAIL words dropped; null for null."""
    t = F.regexp_replace(F.upper(F.trim(c)), "&", " AND ")
    t = F.regexp_replace(t, "[.'’]", "")
    t = squeeze(F.regexp_replace(t, r"[^A-Z0-9\s]", " "))
    word = lambda w: F.coalesce(*[F.when(w == k, F.lit(v)) for k, v in TOKENS.items()], w)
    return F.regexp_replace(F.array_join(F.transform(F.split(t, " "), word), " "), r"( ?\bTRAIL)+$", "")


def tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(name, " "), lambda w: w != ""))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the larger number of tokens; 0 if a side has none."""
    x, y = tokens(a), tokens(b)
    most = F.greatest(F.size(x), F.size(y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)).cast("double") / most)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for equal names."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b).cast("double") / most)


def score_columns(a: Column, b: Column) -> dict[str, Column]:
    """similarity, overlap and score (0 to 100) of two normalised names."""
    sim, over = similarity(a, b), token_overlap(a, b)
    base = F.greatest(SIMILARITY_WEIGHT * sim, OVERLAP_WEIGHT * over)
    lifted = base + F.when(sim >= SIMILARITY_FROM, SIMILARITY_BONUS).otherwise(0.0) + F.when(over >= OVERLAP_FROM, OVERLAP_BONUS).otherwise(0.0)
    score = F.when(a == b, F.lit(100.0)).otherwise(F.least(F.lit(100.0), round_half_up(lifted, 0)))
    return {"similarity": round_half_up(sim, 3), "overlap": round_half_up(over, 3), "score": score.cast("long")}


def slugify(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("trail"))


def safe_filename(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r"[^A-Za-z0-9._-]", "_")


def first_text(*cs: Column) -> Column:
    """The first value that isn't blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in cs])


def regex_ok(c: Column, pattern: str, most: int) -> Column:
    return F.coalesce(c.rlike(pattern) & (F.length(c) <= most), F.lit(False))
