"""Connected components over an edge list, and lineage cuts for loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a session on one machine may name none; it gets one of its own."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the shared folder.

    A table read again has its true size, so small ones are broadcast; a checkpoint would carry the estimate of the
    plan before it, which joins multiply round by round.
    """
    return written(df)[0]


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as ``checkpoint`` gives it, and the path of its table, for ``discard``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of ``written`` that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def connected_components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, label) of all nodes of (a, b): equal labels where a path joins two nodes.

    Each round a node moves to its neighbour of least hash and edges are rewritten between labels, which takes a
    constant share of the labels away, so rounds follow the logarithm of the graph; the moves, which shrink with
    the edges, are put together from the last round back. RuntimeError if edges are left after ``rounds`` rounds.
    """
    e = edges.select("a", "b").where("a <> b").distinct()
    moves = []
    for step in range(rounds + 1):
        e = checkpoint(e)
        if e.isEmpty():
            break
        if step == rounds:
            raise RuntimeError(f"components aren't complete after {rounds} rounds")
        place = lambda c: F.struct(F.xxhash64(c, F.lit(step)), c.alias("n"))
        least = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min(place(F.col("b"))).alias("m"))
        move = checkpoint(least.select("a", F.least(F.col("m"), place(F.col("a")))["n"].alias("to")))
        moves.append(move)
        e = e.join(move.withColumnRenamed("to", "x"), "a").join(move.select(F.col("a").alias("b"), F.col("to").alias("y")), "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    if not moves:
        return e.select(F.col("a").alias("node"), F.col("a").alias("label"))
    labels = moves[-1].withColumnsRenamed({"a": "node", "to": "label"})
    for move in reversed(moves[:-1]):
        labels = move.join(labels.withColumnRenamed("node", "to"), "to", "left").select(F.col("a").alias("node"), F.coalesce("label", "to").alias("label"))
    return checkpoint(labels)
