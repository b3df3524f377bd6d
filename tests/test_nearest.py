"""Bounded search against all samples times all edges and points."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions.geo import closest_on_edge, distance, point
from lodestone.functions.numbers import round_half_up
from lodestone.operators import nearest as N
from lodestone.operators.traces import trusted_lines

POINTS = "activity_key string, component_idx int, point_idx int, lon double, lat double"


def plain(pair, samples, points, longest=120.0):
    """Every sample against every edge and every point of the activity."""
    probe = pair.join(samples, "segment_key")
    e = trusted_lines(points, longest).where(F.col("gap") <= longest).select("activity_key", "component_idx", "line_idx", "point_idx", "a", "b")
    key = ["activity_key", "segment_key", "sample_idx", "component_idx"]
    on_edge = probe.join(e, "activity_key").withColumn("c", closest_on_edge(F.col("place"), F.col("a"), F.col("b")))
    line = on_edge.groupBy(*key, "line_idx").agg(F.min(F.struct(F.col("c.distance").alias("d"), "point_idx", F.struct("c.lon", "c.lat").alias("at"))).alias("m"))
    line = line.select(*key, round_half_up(F.col("m.d"), 3).alias("d"), F.lit(0).alias("kind"), F.col("line_idx").cast("long").alias("o"), "m.at")
    p = points.select("activity_key", "component_idx", F.col("point_idx").cast("long").alias("o"), point(F.col("lon"), F.col("lat")).alias("at"))
    one = probe.join(p, "activity_key").select(*key, distance(F.col("place"), F.col("at")).alias("d"), F.lit(1).alias("kind"), "o", "at")
    best = line.unionByName(one).groupBy(*key).agg(F.min(F.struct("d", "kind", "o", "at")).alias("m"))
    return best.select(*key, round_half_up(F.col("m.d"), 3).alias("distance"), "m.at")


def rows(df):
    return {(r.activity_key, r.segment_key, r.component_idx, r.sample_idx): (r.distance, round(r["at"].lon, 9), round(r["at"].lat, 9)) for r in df.collect()}


def walk(rng, key, component, n, step=0.0004, grid=False):
    x, y, out = -71.0, 44.0, []
    for i in range(n):
        out.append((key, component, i, round(x, 4) if grid else x, round(y, 4) if grid else y))
        x, y = x + rng.uniform(-0.3, 1) * step, y + rng.uniform(-1, 1) * step
        if rng.random() < 0.05:
            x += 0.004  # too far to be an edge
    return out


@pytest.mark.parametrize("seed,part,block,chunk", [(1, 256, 64, 16), (2, 8, 4, 3), (3, 16, 5, 1), (4, 5, 1, 16)])
def test_equal_to_all_pairs(spark, seed, part, block, chunk):
    rng = random.Random(seed)
    # coarse places tie often; one component is a single point, one activity meets no segment
    data = walk(rng, "long", 0, 300) + walk(rng, "ties", 0, 60, 0.001, True) + walk(rng, "ties", 1, 60, 0.001, True) + walk(rng, "one", 0, 1) + walk(rng, "none", 0, 9)
    data += [("back", 0, i, -71.0 + 0.0004 * min(i, 40 - i), 44.0) for i in range(41)]
    points = spark.createDataFrame(data, POINTS)
    samples = spark.createDataFrame([(f"s{k}", i, (-71.0 + 0.001 * (i - 4) * (1 + k), 44.0 + 0.0007 * k)) for k in range(3) for i in range(25)], "segment_key string, sample_idx int, place struct<lon:double,lat:double>")
    pair = spark.createDataFrame([(a, f"s{k}") for a in ("long", "ties", "one", "back") for k in range(3)], "activity_key string, segment_key string")
    want = rows(plain(pair, samples, points))
    assert len(want) == 25 * 3 * 5
    assert rows(N.nearest(pair, samples, points, part=part, block=block, chunk=chunk, slot_probes=2 if seed > 1 else 4096)) == want


def test_far_away_and_near_the_pole(spark):
    data = [("a", 0, i, 179.0 + 0.001 * i, 89.0) for i in range(20)] + [("a", 1, i, -179.0, -89.0 + 0.0005 * i) for i in range(20)]
    points = spark.createDataFrame(data, POINTS)
    samples = spark.createDataFrame([("s", i, (-179.9 + 20.0 * i, -80.0 + 9.0 * i)) for i in range(18)], "segment_key string, sample_idx int, place struct<lon:double,lat:double>")
    pair = spark.createDataFrame([("a", "s")], "activity_key string, segment_key string")
    want = {k: v[0] for k, v in rows(plain(pair, samples, points)).items()}
    got = {k: v[0] for k, v in rows(N.nearest(pair, samples, points, part=4, block=3, chunk=2)).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 0.001 for k in want)


def test_points_without_places_and_empty_tables(spark):
    points = spark.createDataFrame([("a", 0, 0, -71.0, 44.0), ("a", 0, 1, None, 44.0), ("a", 0, 2, float("nan"), 44.0), ("a", 0, 3, -71.0, 44.001)], POINTS)
    samples = spark.createDataFrame([("s", 0, (-71.0, 44.0))], "segment_key string, sample_idx int, place struct<lon:double,lat:double>")
    pair = spark.createDataFrame([("a", "s")], "activity_key string, segment_key string")
    assert [r.distance for r in N.nearest(pair, samples, points).collect()] == [0.0]
    for empty in (N.nearest(pair.limit(0), samples, points), N.nearest(pair, samples.limit(0), points), N.nearest(pair, samples, points.limit(0))):
        assert empty.collect() == []


def test_a_long_trace_is_measured_in_few_places(spark):
    import numpy as np

    n, far = 20_000, []
    p = {"i": np.arange(n), "line": np.zeros(n, int), "lon": -71 + 0.0004 * np.arange(n), "lat": np.full(n, 44.0), "to_lon": -71 + 0.0004 * np.arange(1, n + 1), "to_lat": np.full(n, 44.0)}
    s = {"i": np.arange(50), "lon": -70.0 + 0.0002 * np.arange(50), "lat": np.full(50, 44.0003)}
    measure = N._on_edge
    try:
        N._on_edge = lambda *a: far.append(len(a[0])) or measure(*a)
        won = N.search(s, np.array([0, 50]), p, np.array([0, n]), 16)
    finally:
        N._on_edge = measure
    assert sum(far) <= 50 * 3 * 16 and (abs(won["value"] - 33.4) < 0.1).all()


def test_rows_of_blocks_hold_what_single_samples_find(spark):
    """Every kind of row: bundles, several blocks, components of several parts; a row a block and bundle, not one a sample and component."""
    rng = random.Random(7)
    data = walk(rng, "long", 0, 90) + [p for k in range(12) for p in walk(rng, "many", k, 5)] + walk(rng, "few", 0, 4) + walk(rng, "few", 1, 4, 0.001, True)
    points = spark.createDataFrame(data, POINTS)
    samples = spark.createDataFrame([(f"s{k}", i, (-71.0 + 0.0004 * i, 44.0 + 0.0002 * k)) for k in range(4) for i in range(4 + 9 * k)], "segment_key string, sample_idx int, place struct<lon:double,lat:double>")
    pair = spark.createDataFrame([(a, f"s{k}") for a in ("long", "many", "few") for k in range(4)], "activity_key string, segment_key string")
    one = N.nearest(pair, samples, points, part=16, block=8).collect()
    made = N.measured(pair, samples, points, 25.0, part=16, block=8, most_probes=3, most_points=20).collect()
    got = {(r.activity_key, r.segment_key, c, i): m / 1000 for r in made for c, mm in zip(r.component_idx, r.mm, strict=True) for i, m in zip(r.i, mm, strict=True)}
    assert got == {(r.activity_key, r.segment_key, r.component_idx, r.sample_idx): r.distance for r in one}
    assert all(list(r.least) == [min(x) for x in zip(*r.mm, strict=True)] for r in made) and len(made) < len(got) / 8
    assert {r.alone for r in made} == {True, False} and {(r.activity_key, r.segment_key) for r in made if r.alone} == {("few", "s0")}
    for name, sign in (("first", 1), ("last", -1)):
        want, best = {}, {}
        for r in one:
            if r.distance <= 25.0:
                key, x = (r.activity_key, r.segment_key), (sign * r.sample_idx, round(r.distance * 1000), r.component_idx, r["at"].lon, r["at"].lat)
                want[key] = min(want.get(key, x), x)
        for r in made:
            if r[name] is not None:
                key = (r.activity_key, r.segment_key)
                best[key] = min(best.get(key, tuple(r[name])), tuple(r[name]))
        assert want and best.keys() == want.keys() and all(best[k][:3] == w[:3] and best[k][3:] == pytest.approx(w[3:], abs=1e-9) for k, w in want.items())
