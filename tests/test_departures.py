from pyspark.sql import functions as F

from lodestone.operators import cleaning, serving
from lodestone.operators.cleaning import PRIVATE
from lodestone.sources import sinks


def test_private_paths(spark):
    rows = [("x", "/Users/a"), ("x", "/home/a"), ("x", "/homestead/a"), ("x", "/data/a"), ("x", "C:\\a"), ("folder", "a/b"), ("sourceFilename", "a\\b"), ("filename", "plain"), ("profile", "a/b"), ("direction", "n/s"), ("x", None)]
    got = [r.v for r in spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(rows)], "i int, k string, v string").select("i", cleaning.redact_paths(F.create_map("k", "v"))[F.col("k")].alias("v")).orderBy("i").collect()]
    assert [g == PRIVATE for g in got] == [True, True, False, False, True, True, True, False, False, False, False]
    assert got[-1] is None


def test_profiles(spark):
    names = ["ab", "abc", "a" * 32, "a" * 33, "Abc", "-bc", None]
    df = spark.createDataFrame([(n, "x") for n in names], "username string, display_name string")
    assert [r.username for r in serving.public_profile(df).collect()] == ["abc", "a" * 32, None]


def test_a_lost_upsert_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a", 1)], "k int, v string, at int")
    assert sinks.upsert_table(one, path, ["k"], ["at"]) == 1
    (tmp_path / "t").rename(tmp_path / "t.old")  # as if the run had ended between the two renames
    two = spark.createDataFrame([(1, "b", 2), (2, "c", 1)], "k int, v string, at int")
    assert sinks.upsert_table(two, path, ["k"], ["at"]) == 2
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "b"), (2, "c")]
    assert not (tmp_path / "t.old").exists()
