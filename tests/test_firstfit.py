"""Ordered first fit against the sequential rule on generated places."""

import random
import time
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import firstfit as P
from lodestone.operators import topology as T
from lodestone.operators.graph import shared_folder
from lodestone.operators.topology import metres

SCHEMA = "ord array<long>, place struct<lon:double,lat:double>, reason string, many int"


def plain(rows, near, wide):
    """Each place in turn looks through the clusters made so far: (ord of the cluster's first, spread)."""
    made, out = [], {}
    for order, (x, y), reason in sorted(rows):
        p, kind = {"lon": x, "lat": y}, reason.startswith("ambiguous")
        limit = wide if kind else near
        home = next((c for c in made if c[0][2] == kind and any(metres(q, p) <= limit for _, q, _ in c)), None)
        if home is None:
            home = []
            made.append(home)
        home.append((order, p, kind))
    for c in made:
        spread = max((metres(p, q) for _, p, _ in c for _, q, _ in c), default=0.0)
        out |= {tuple(o): (".".join(map(str, c[0][0])), round(spread, 6)) for o, _, _ in c}
    return out


def got(spark, rows, near, wide, cell=0.002):
    d = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA)
    c = T.clusters(d, T.Tolerances(junction_dedup=near, intersection=wide), cell)
    out = c.select("ord", "cluster", "spread").collect()
    assert len(out) == len(rows)
    return {tuple(r["ord"]): (r["cluster"], round(r["spread"], 6)) for r in out}


def test_many_generated_sets_at_once(spark):
    """2,000 sets, far from each other: chains, clumps, places that repeat; each set's clusters are its own."""
    rng, rows = random.Random(1), []
    for s in range(2000):
        n, size = rng.randint(1, 14), rng.choice([0.0, 2e-5, 6e-5, 2e-4])
        x, y = -70.0 + 0.01 * (s % 50), 40.0 + 0.01 * (s // 50)
        order = rng.sample(range(100), n)
        at = [(x + rng.uniform(0, size), y + rng.uniform(0, size)) for _ in range(n)]
        rows += [([s, k, 1], at[rng.randrange(i + 1)] if rng.random() < 0.3 else at[i], rng.choice(["trail_endpoint", "trail_endpoint", "ambiguous_near_intersection"])) for i, k in enumerate(order)]
    by_set = {}
    for r in rows:
        by_set.setdefault(r[0][0], []).append(r)
    want = {}
    for few in by_set.values():
        want |= plain(few, 4.0, 8.0)
    assert got(spark, rows, 4.0, 8.0) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_one_dense_component(spark, seed):
    rng = random.Random(seed)
    rows = [([i], (-70.0 + rng.uniform(0, 0.004), 44.0 + rng.uniform(0, 0.0005)), "trail_endpoint") for i in rng.sample(range(10_000), 700)]
    rows += [([20_000 + i], rows[3][1], "trail_endpoint") for i in range(50)]
    assert got(spark, rows, 15.0, 15.0) == plain(rows, 15.0, 15.0)


def test_a_long_chain_takes_few_rounds(spark):
    n = 20_000
    d = spark.range(n).select(F.array("id").alias("ord"), F.struct((-70.0 + F.col("id") * 1e-5).alias("lon"), F.lit(0.0).alias("lat")).alias("place"), F.lit("trail_endpoint").alias("reason"))
    began = time.time()
    c = T.clusters(d, T.Tolerances(junction_dedup=1.5, intersection=1.5)).agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("c"), F.max("spread").alias("s")).collect()[0]
    assert (c.n, c.c) == (n, 1) and abs(c.s - metres({"lon": -70.0, "lat": 0.0}, {"lon": -70.0 + (n - 1) * 1e-5, "lat": 0.0})) < 0.01
    assert time.time() - began < 150


def test_tables_of_the_rounds_are_deleted(spark):
    folder = Path(urlparse(shared_folder(spark)).path)
    before = set(folder.iterdir())
    items = spark.range(2000).select(F.col("id").alias("ord"))
    first = P.first_fit(items, items.where("ord > 0").select(F.col("ord").alias("x"), (F.col("ord") - 1).alias("y")))
    assert {tuple(r) for r in first.select("first").distinct().collect()} == {(0,)} and first.count() == 2000
    assert len(set(folder.iterdir()) - before) == 1


def test_places_about_a_pole_and_on_both_sides_of_the_date_line(spark):
    rng = random.Random(5)
    places = [(rng.uniform(-180, 180), 90 - rng.choice([0.0002, 0.001, 0.004]) * rng.random()) for _ in range(60)]
    places += [(rng.choice([-179.9995, 179.9995]) + rng.uniform(-0.0005, 0.0005), 10 + rng.uniform(0, 0.004)) for _ in range(60)]
    rows = [([i], p, "trail_endpoint") for i, p in enumerate(rng.sample(places, len(places)))]
    assert got(spark, rows, 40.0, 40.0) == plain(rows, 40.0, 40.0)


def test_places_beyond_a_pole_cost_no_more_than_others(spark):
    """A hundred lines of places at latitudes to 900: before, each place went to 60,000 cells."""
    d = spark.range(50_000).select(F.array("id").alias("ord"), (F.col("id") % 100).alias("line"), F.floor(F.col("id") / 100).alias("k"))
    d = d.select("ord", F.struct((-71.0 + 0.0004 * F.col("k") + 0.002 * F.floor(F.col("k") / 5)).alias("lon"), (9.0 * F.col("line") + 1.0).alias("lat")).alias("place"), F.lit("trail_endpoint").alias("reason"), "line")
    began = time.time()
    c = T.clusters(d, T.Tolerances(junction_dedup=60.0, intersection=60.0)).groupBy("line").agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("c")).collect()
    assert {r.line: (r.n, r.c) for r in c} == {i: (500, 100 if metres({"lon": 0, "lat": 9.0 * i + 1}, {"lon": 0.0024, "lat": 9.0 * i + 1}) > 60 else 1) for i in range(100)}
    assert time.time() - began < 100


def _beginnings(rows):
    """(x, y or None) of edges to earlier items: the least beginning that each item's paths lead to."""
    c = {}
    for x, y in sorted(rows, key=lambda r: (r[0], r[1] is not None)):
        c.setdefault(x, None)
        if y is not None:
            c[x] = c[y] if c[x] is None else min(c[x], c[y])
        elif not any(a == x and b is not None for a, b in rows):
            c[x] = x
    return c


@pytest.mark.parametrize("buffer", [1, 7, 1 << 18])
def test_items_are_settled_whatever_is_looked_at_at_once(monkeypatch, buffer):
    monkeypatch.setattr(P, "BUFFER", buffer)
    rng = random.Random(9)
    rows = [(x, None) for x in range(100, 160)] + [(x, rng.randrange(max(100, x - 9), x)) for x in range(101, 160) for _ in range(rng.randrange(3))]
    rows += [(x, rng.randrange(100)) for x in (103, 130)]  # of another task
    rows.sort(key=lambda r: r[0])
    batches = [pa.RecordBatch.from_pylist([{"x": x, "y": y} for x, y in rows[i : i + 5]], schema=pa.schema([("x", pa.int64()), ("y", pa.int64())])) for i in range(0, len(rows), 5)]
    out = [r for b in P._settle(iter(batches)) for r in b.to_pylist()]
    want = _beginnings(rows + [(y, None) for _, y in rows if y is not None and y < 100])
    c = {r["x"]: r["c"] for r in out if r["settled"]}
    assert all(c[x] == want[x] for x in c) and len(c) > (0 if buffer < 9 else 5)
    left = [(r["x"], r["y"]) for r in out if not r["settled"]]
    assert {x for x, y in left if y is None} == set(range(100, 160)) - set(c)
    ends = {x: {r["c"] for r in out if r["x"] == x and r["c"] is not None} for x, _ in left}
    for x, y in sorted(left, key=lambda r: r[0]):  # what is left leads to the same beginnings
        if y is not None:
            ends[x] |= ends[y] if y in ends else {c.get(y, y)}
    assert all(min(e) == want[x] for x, e in ends.items())


def test_rounds_over_items_of_many_blocks(spark):
    rng = random.Random(3)
    ids = sorted(rng.sample(range(1 << 40), 300)) + [(1 << 41) + i for i in range(300)]
    rows = [(x, None) for x in ids] + [(ids[i], ids[rng.randrange(max(0, i - 40), i)]) for i in range(1, 600) for _ in range(rng.randrange(3))]
    items = spark.createDataFrame([(x,) for x in ids], "ord long")
    edges = spark.createDataFrame([r for r in rows if r[1] is not None], "x long, y long")
    assert {r.ord: r["first"] for r in P.first_fit(items, edges).collect()} == _beginnings(rows)


def test_hulls_keep_the_farthest_pair():
    rng = np.random.default_rng(4)
    for k in range(200):
        n = int(rng.integers(1, 60))
        lon, lat = rng.normal(10, 10.0 ** rng.integers(-6, 1), n), rng.normal(50, 10.0 ** rng.integers(-6, 1), n)
        if k % 3 == 0:
            lat[:] = 50 + (lon - 10)  # on a line
        h = P._hull(lon, lat)
        assert abs(P._diameter(lon[h], lat[h]) - P._diameter(lon, lat)) < 1e-5


def test_empty(spark):
    assert got(spark, [], 1.0, 1.0) == {}
