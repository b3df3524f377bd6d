"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all executors share.

    Only a session on one machine (tests, a notebook) may name none; it gets a folder of its own.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def write_shared(df: DataFrame) -> DataFrame:
    """Like checkpoint(), but as a Parquet table in the same shared folder: a fraction of the bytes for long narrow tables.

    Loops use it: a table read again has its true size, while a checkpoint carries the estimate of the plan before it,
    which joins multiply round by round.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_shared(spark: SparkSession, path: str) -> None:
    """Delete a table under the shared folder that no later plan reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 200) -> DataFrame:
    """(node, label) for every node of ``edges``; nodes share a label iff a path joins them.

    Random-mate contraction: each round every node moves to its neighbour of least hash, and the edges are
    rewritten between the new labels. A constant fraction of labels goes in each round, so the number of
    rounds grows with the logarithm of the graph. The moves of a round shrink with its edges; they are put
    together from the last round back, so no round touches all nodes again. Minima are combined before the
    shuffle, and joins are plain equi-joins that AQE can split, so one node may hold a large share of all edges.
    Edges with a null end are ignored. An empty input gives an empty result. RuntimeError if edges are left
    after ``rounds`` rounds.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    moves = []
    for step in range(rounds + 1):
        e = write_shared(e)
        if e.isEmpty():
            break
        if step == rounds:
            raise RuntimeError(f"components aren't complete after {rounds} rounds")
        order = lambda c: F.struct(F.xxhash64(c, F.lit(step)), c.alias("n"))
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(order(F.col("b"))).alias("m"))
        move = write_shared(least.select("a", F.least(F.col("m"), order(F.col("a")))["n"].alias("to")))
        moves.append(move)
        e = (
            e.join(move.withColumnsRenamed({"to": "x"}), "a")
            .join(move.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
    if not moves:
        return e.select(F.col("a").alias("node"), F.col("a").alias("label"))
    labels = moves[-1].withColumnsRenamed({"a": "node", "to": "label"})
    for move in reversed(moves[:-1]):
        later = labels.withColumnsRenamed({"node": "to"})
        labels = move.join(later, "to", "left").select(F.col("a").alias("node"), F.coalesce("label", "to").alias("label"))
    return write_shared(labels)
