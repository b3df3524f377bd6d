"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, read, write_shared


def _unit(c: Column, salt: str) -> Column:
    """A fixed number in [0, 1) for each value, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}:"), F.coalesce(c.cast("string"), F.lit("\u0000")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """source, source_size, target from rows of (source, size).

    Sources in code-point order, null last, take ``weights`` in turn and share the sum of all sizes. No target
    exceeds ``most`` times its source's size; what is over is shared again by weight among the others until none
    is above. That is water-filling: with sources sorted by cap per weight, the ones before the first that fits
    stay at their caps, and the rest share what is left. The windows here run over one row per source, after
    aggregation, never over documents. A total of 0 gives targets of 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everywhere = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / F.sum("w").over(onward)
    per = per.withColumn("level", level).withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
    shared = F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(everywhere)
    return per.withColumn("shared", shared).select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("shared") * F.col("w")), F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0, seed: str = "mix", cell_rows: int = 1000, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row of ``docs`` (doc_id, source, text), and the columns ``carry``.

    Each document of a source is expected target / source_size times. Expected copies are summed along the source,
    from short to long documents, one offset in [0, 1) is added, and a document is emitted once for each integer
    that its step crosses. The running sum is split so that no task holds a whole source: a cell is one source, one
    length class and, where a class has over ``cell_rows`` rows, one of several hash ranges of doc_id. Counts of
    classes and of the cells in a class give the sum before each cell; inside a cell rows are numbered by (size,
    doc_id). Only ids, sources and sizes are shuffled.

    Null or empty texts have size 0 and still may be emitted; they add no words. Null sources form a source of
    their own. Repeated rows are separate documents. An empty table gives an empty result. All hashes are of
    values, so reruns agree.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    carried = F.struct(*[docs[c] for c in carry]) if carry else F.lit(None)
    rows = checkpoint(docs.select("doc_id", "source", size.alias("size"), carried.alias("carried")).withColumn("class", F.length(F.bin("size"))))
    classes = rows.groupBy("source", "class").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    targets = source_targets(classes, weights, most)
    # one row per source and length class: what a cell's rows need to know
    shorter = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)  # some 60 classes at most
    t, c = targets.alias("t"), classes.withColumn("shorter", F.coalesce(F.sum("n").over(shorter), F.lit(0))).alias("c")
    plan = c.join(t, F.col("c.source").eqNullSafe(F.col("t.source"))).select(
        F.col("c.source").alias("p_source"), F.col("c.class").alias("p_class"), "source_size", "target", "shorter", F.ceil(F.col("n") / cell_rows).alias("parts")
    )
    part = F.least(F.floor(_unit(F.col("doc_id"), seed) * F.col("parts")), F.col("parts") - 1)
    celled = rows.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("class") == F.col("p_class"))).withColumn("part", part).drop("p_source", "p_class", "parts")
    counts = celled.groupBy("source", "class", "part").agg(F.count("*").alias("n"))
    along = Window.partitionBy("source", "class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("source").alias("s_source"), F.col("class").alias("s_class"), F.col("part").alias("s_part"), F.coalesce(F.sum("n").over(along), F.lit(0)).alias("first"))
    inside = Window.partitionBy("source", "class", "part").orderBy("size", "doc_id")
    ranked = celled.withColumn("k", F.row_number().over(inside)).join(starts, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("class") == F.col("s_class")) & (F.col("part") == F.col("s_part")))
    rate = F.least(F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0)), F.lit(float(most)))
    crossed = lambda k: F.floor(rate * k + _unit(F.col("source"), seed))
    at = (F.col("shorter") + F.col("first") + F.col("k")).cast("double")
    copies = F.least(crossed(at) - crossed(at - 1), F.lit(int(-(-most // 1)))).cast("long")
    return ranked.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[F.col("carried")[c].alias(c) for c in carry])


def mixed(docs: DataFrame, **how) -> DataFrame:
    """Each row of ``docs``, all columns, with what ``mix`` says of it: size, source_size, target, copies, taken.

    Rows get a number of their own in a table in the shared folder, and the mix is joined on it, so rows that repeat
    a doc_id or have none stay apart. A column of ``docs`` that has the name of one of the five is replaced.
    """
    row = "row"
    while row in docs.columns:
        row += "_"
    held = write_shared(docs.withColumn(row, F.monotonically_increasing_id()))
    got = mix(held, carry=[row], **how).select(row, "size", "source_size", "target", "copies", "taken")
    return held.select(row, *[c for c in docs.columns if c not in got.columns]).join(got, row).drop(row)


def emit(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of ``docs``, its columns only, once for each copy taken."""
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("held"), "doc_id", "source", "text")
    return mixed(held, **how).where("copies > 0").select("held", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("one")).select("held.*")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix of all documents takes each one."""
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "copies", "taken")


OP9_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), n AS (
  SELECT *, [1.0, 2.0, 3.0][((row_number() OVER (ORDER BY source IS NULL, source)) - 1) % 3 + 1]::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM n
), f AS (
  SELECT *, (SELECT max(level) FROM l) AS shared FROM l
), t AS (
  SELECT source, source_size, coalesce(least(cap, shared * w), 0) AS target FROM f
), r AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
    row_number() OVER (PARTITION BY d.source ORDER BY length(bin(d.size)), d.size, d.doc_id)::DOUBLE AS k,
    coalesce(least(t.target / nullif(t.source_size, 0)::DOUBLE, 3.0::DOUBLE), 0) AS rate,
    ('0x' || substr(md5('mix:' || coalesce(d.source, chr(0))), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, least(floor(rate * k + u) - floor(rate * (k - 1) + u), 3)::BIGINT AS copies FROM r
)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM c
"""
