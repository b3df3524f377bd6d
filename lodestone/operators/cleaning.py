"""Row checks and cleaning of open data: constraints, quarantine, private paths, inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import normalize_name, squeeze
from .issues import every, issues

PRIVATE = "private path omitted"


def constraints(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that meet all checks, the others with the names of those they fail). A check that is null fails."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    marked = df.withColumn("failed", failed)
    return marked.where(F.size("failed") == 0).drop("failed"), marked.where(F.size("failed") > 0)


#: Roots of private absolute paths, and words in the names of keys that hold paths.
PRIVATE_ROOTS = ("Users", "home", "private", "var", "tmp", "Volumes")
PATH_WORDS = ("path", "filepath", "directory", "folder", "filename", "sourcefilename")


def private_path(key: Column, value: Column) -> Column:
    """Whether the text is an absolute path below a drive or a private root, or holds a slash under a key that names a path."""
    absolute = value.rlike(r"^[a-zA-Z]:[\\/]") | value.rlike(rf"^/({'|'.join(PRIVATE_ROOTS)})\b")
    return absolute | (F.lower(key).rlike("|".join(PATH_WORDS)) & value.rlike(r"[\\/]"))


def redact_paths(values: Column) -> Column:
    """A map of text with private paths replaced. Nulls stay."""
    return F.transform_values(values, lambda k, v: F.when(F.coalesce(private_path(k, v), F.lit(False)), F.lit(PRIVATE)).otherwise(v))


def validate_inventory(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, issues, duplicate names) of (row_no, item_key, name, region_hint, notes); the header is row 1."""
    rows = raw.select("row_no", *[squeeze(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("item_key", "name", "region_hint", "notes")])
    w = Window.partitionBy("item_key").orderBy("row_no")
    rows = rows.withColumn("again", (F.col("item_key") != "") & (F.row_number().over(w) > 1))
    at = lambda *t: F.concat(F.lit("Row "), F.col("row_no").cast("string"), F.lit(": "), *t)
    wrong = issues(rows, [
        ("required_key", F.col("item_key") == "", at(F.lit("item_key is required."))),
        ("required_name", F.col("name") == "", at(F.lit("name is required."))),
        ("duplicate_key", F.col("again"), at(F.lit("duplicate item_key '"), F.col("item_key"), F.lit("'."))),
    ])
    items = rows.where((F.col("item_key") != "") & (F.col("name") != "") & ~F.col("again")).drop("again").withColumn("normalized", normalize_name(F.col("name")))
    twice = items.groupBy("normalized").agg(F.count("*").alias("n"), F.min("row_no").alias("first_row")).where("n > 1")
    return items, every(wrong), twice
