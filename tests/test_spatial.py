from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions.geo import boxes_near
from lodestone.operators.spatial import box_join, onward_cells, own_margin, place_pairs, with_cells
from lodestone.operators.topology import metres as haversine

BOX = "i int, box struct<x1:double,y1:double,x2:double,y2:double>"


@pytest.mark.parametrize("low, high", [(43, 45), (79.9, 80.1), (-85.1, -84.9), (88.9, 89.05)])
def test_pairs_at_any_latitude_are_those_of_the_exact_test(spark, low, high):
    rng, metres = np.random.default_rng(6), 100.0

    def side(name):
        boxes = []
        for i in range(60):
            x, y = rng.uniform(10, 10.03), (low + high) / 2 + rng.uniform(-0.001, 0.001)
            tall = (high - low) / 2 if i == 0 else 0.0002
            boxes.append((i, (float(x), float(y), float(x + 0.0005), float(y + tall))))
        return spark.createDataFrame(boxes, BOX).withColumnsRenamed({"i": f"{name}i", "box": f"{name}box"})

    a, b = side("l"), side("r")
    near = boxes_near(F.col("lbox"), F.col("rbox"), metres)
    want = sorted(map(tuple, a.crossJoin(b).where(near).select("li", "ri").collect()))
    for cell in (0.002, 0.01):
        assert sorted(map(tuple, box_join(a, b, metres, cell).where(near).select("li", "ri").collect())) == want
    assert 0 < len(want) <= len(list(product(range(60), repeat=2)))


def test_a_box_near_a_pole_touches_few_cells(spark):
    boxes = [(i, (10.0, y, 10.0005, y + 0.0002)) for i, y in enumerate((44.0, 89.0, 89.9, 89.99, 89.999, 89.9997, -89.9999, 90.0, 95.0))]
    d = spark.createDataFrame(boxes, BOX)
    n = with_cells(d, F.col("box"), 0.002, 100 / 111_320, own_margin(F.col("box"), 100.0)).groupBy("i").count().collect()
    assert len(n) == len(boxes) and max(r["count"] for r in n) <= 24  # 200,000 at the pole before


@pytest.mark.parametrize("limit, cell", [(60.0, 0.002), (200.0, 0.0007), (3.0, 0.002)])
def test_places_meet_at_the_poles_at_the_date_line_and_in_few_cells(spark, limit, cell):
    rng, at = np.random.default_rng(7), []
    for lat in (0.0, 44.0, 89.0, 89.9985, 89.9995, -89.9997, 90.0, 100.0, 270.0, 899.99):
        for lon in (-70.0, 179.9995):
            at += [(float(lon + d), float(lat + e)) for d, e in zip(rng.choice([1e-5, 1e-3, 0.3, 170.0], 25) * rng.uniform(-1, 1, 25), rng.uniform(-0.0015, 0.0015, 25), strict=True)]
    at = [(x - 360 if x > 180 else x + 360 if x < -180 else x, y) for x, y in at]
    d = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "i int, lon double, lat double")
    places = d.withColumnRenamed("i", "id")
    point = [{"lon": x, "lat": y} for x, y in at]
    want = sorted((i, k) for i, k in combinations(range(len(at)), 2) if haversine(point[i], point[k]) <= limit and abs(at[i][1] - at[k][1]) * 111_194.92 <= limit)
    assert len(want) > (40 if limit > 10 else 0)
    assert sorted(tuple(sorted(r)) for r in place_pairs(places, F.lit(limit), cell).select("l_id", "r_id").collect()) == want
    most = onward_cells(places, F.lit(limit), cell).groupBy("id").count().agg(F.max("count")).first()[0]
    rows = 2 * limit / (111_000 * cell) + 2
    assert most <= 8 * rows**2  # a margin by the longitude alone took 60,000 cells at 60 m
