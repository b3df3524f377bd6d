import hashlib
import math

import numpy as np
import pytest

from lodestone.llm import lloyd as L

from ..oracle import compare, database

SCHEMA = "vec_id long, embedding array<float>, label int, key long, x int, cluster int, distance int, moved string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 7, 8, 9, 10, "m") for i, v in rows], SCHEMA)


def plain(rows, k, rounds, dims):
    """Lloyd rounds over all vectors in Python integers."""
    kept = [(i, [math.floor(1024 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: ((1, "") if r[0] is None else (0, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest()), np.array(r[1], "<i4").tobytes()))
    cs = [x for _, x in order[:k]]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(cs))

    for _ in range(rounds):
        mine = [near(x)[1] for _, x in kept]
        for j in range(len(cs)):
            group = [x for (_, x), m in zip(kept, mine, strict=True) if m == j]
            if group:
                cs[j] = [sum(c) // len(group) for c in zip(*group, strict=True)]
    last = [(i, *near(x)) for i, x in kept]
    total = {j: sum(d for _, d, m in last if m == j) for j in range(len(cs))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted(((i, j, d, total[j], sum(total.values()), sha[j]) for i, d, j in last), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_given_tables_against_sql(spark, sf):
    assert compare(L.op12_delta_lloyd(spark, sf), database(sf), L.OP12_SQL) == 500


@pytest.mark.parametrize("seed,k,dims,n", [(1, 3, 2, 200), (2, 8, 4, 400), (3, 5, 3, 60), (4, 8, 2, 5)])
def test_rounds_against_plain_lloyd(spark, seed, k, dims, n):
    r = np.random.default_rng(seed)
    # coarse values: many ties and equal vectors
    rows = [(int(i), [float(v) for v in np.round(r.normal(0, 2, dims) + 3 * (i % 4), 1)]) for i in range(n)]
    rows += rows[: n // 3]
    for buckets in (1, 5):
        assert got(L.cluster(frame(spark, rows), k=k, rounds=6, dims=dims, buckets=buckets)) == plain(rows, k, 6, dims)


def test_odd_rows(spark):
    rows = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [1.0, float("inf")]), (7, [0.5, -0.5]), (7, [0.5, -0.5]), (None, [2.0, 2.0]), (8, [-0.0001, 3.0]), (9, [3.0, 1.0, 2.0])]
    assert got(L.cluster(frame(spark, rows), dims=2)) == plain(rows, 8, 10, 2)
    assert len(plain(rows, 8, 10, 2)) == 4
    empty = L.cluster(frame(spark, rows).limit(0), dims=2)
    assert empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and got(empty) == []
    assert got(L.cluster(frame(spark, rows[:6]), dims=2)) == []


def test_outsize_components_are_held(spark):
    r = got(L.cluster(frame(spark, [(1, [1e30] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)]), k=1))
    assert all(0 <= row[2] < 2**63 for row in r) and len(r) == 3


def test_reassign_equals_a_search_over_all():
    r = np.random.default_rng(5)
    for _ in range(300):
        k, x = int(r.integers(1, 6)), r.integers(-3, 4, (30, 2))
        cs = r.integers(-3, 4, (k, 2))
        full = lambda c: (L.squared(x, c).argmin(axis=1), L.squared(x, c).min(axis=1))
        owner, d = full(cs)
        after = cs.copy()
        changed = r.random(k) < 0.5
        after[changed] += r.integers(-2, 3, (int(changed.sum()), 2))
        a, b = L.reassign(x, owner, d, after, changed)
        wa, wb = full(after)
        assert (a == wa).all() and (b == wb).all()


def test_rounds_do_not_shuffle(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    base = L.Bucketed(L.integers(v, 64, 1024).repartition(4, "key"), 4)
    cs = np.zeros((2, 64), np.int64)
    owned = L.Bucketed(L._round(base, None, cs, np.ones(2, bool)), 4)
    plan = L._round(base, owned, cs, np.ones(2, bool))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" in plan
