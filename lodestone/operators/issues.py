"""Rules as data: a rule names a condition on a row and the message of rows that meet it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, Column, Column]  # name, condition that is wrong, message


def issues(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rule, message of every row and rule it breaks, in one pass over ``df``."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(name).alias("rule"), text.alias("message"))) for name, bad, text in rules]))
    return df.select(F.explode(found).alias("i")).select("i.rule", "i.message")


def duplicates(df: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """rule, message for keys that several rows share."""
    return df.groupBy(*keys).count().where("count > 1").select(F.lit(rule).alias("rule"), F.concat(F.lit(f"{rule}:"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys])).alias("message"))


def unknown(df: DataFrame, known: DataFrame, on: Sequence[str], rule: str) -> DataFrame:
    """rule, message for rows of ``df`` whose keys ``known`` doesn't have. An anti join would go below a ``dealt`` table's shuffle."""
    flagged = df.join(known.select(*on).distinct().withColumn("_known", F.lit(True)), list(on), "left").where(F.col("_known").isNull())
    return flagged.select(F.lit(rule).alias("rule"), F.concat(F.lit(f"{rule}:"), F.concat_ws("|", *[F.col(k).cast("string") for k in on])).alias("message"))


def dealt(df: DataFrame, *keys: Sequence[str], rows: int = 1 << 20) -> list[DataFrame]:
    """``df`` by each of ``keys``, about ``rows`` rows to a task however many there are; a smaller table stays as it is.

    Left alone, Spark puts tasks together by compressed bytes, and keys compress so well that a task gets many millions.
    """
    n = df.count() // rows
    tasks = max(n + 1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return [df.repartition(tasks, *k) if n else df for k in keys]


def every(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def assert_clean(found: DataFrame, most: int = 100) -> None:
    """Raise one error with up to ``most`` messages if there is any issue; the only action of a stage's checks."""
    first = found.orderBy("rule", "message").limit(most).collect()
    if first:
        raise ValueError("\n".join(r.message for r in first))
