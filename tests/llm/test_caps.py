from itertools import combinations

import numpy as np
import pytest

from lodestone.llm import caps as C

from .cases import components

SCHEMA = "vec_id long, embedding array<float>, label int, a string, key string, n int, dims int, least long"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], c, "x", "k", 1, 2, 3) for i, v, c in rows], SCHEMA)


def brute(rows):
    ok = {}
    for i, v, c in rows:
        if c is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            ok[i] = (c, x / np.linalg.norm(x))
    links = [(i, j) for i, j in combinations(ok, 2) if ok[i][0] == ok[j][0] and len(ok[i][1]) == len(ok[j][1]) and ok[i][1] @ ok[j][1] >= C.COSINE]
    return links, components([i for i, _, _ in rows], links)


def got(df, **how):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in C.near_duplicates(df, **how).collect()}


def check(rows, out, recall):
    links, comp = brute(rows)
    n = {i: sum(i in p for p in links) for i, _, _ in rows}
    assert set(out) == set(n)
    assert all(out[i][0] <= n[i] for i in n)
    assert sum(v[0] for v in out.values()) >= recall * sum(n.values())
    right = sum(out[i][1] == comp[i] for i in n)
    assert right >= recall * len(n)
    assert all(v[2] == (v[1] == i) for i, v in out.items())


def test_real_vectors(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(rows, got(C.read(spark, sf, "embeddings")), 0.95)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(2)
    rows = []
    for k in range(40):
        centre = rng.standard_normal(64)
        for _ in range(10):
            v = centre / np.linalg.norm(centre) + rng.standard_normal(64) * rng.uniform(0.01, 0.045)
            rows.append((len(rows), v.tolist(), k % 3))
    same = rng.standard_normal(64).tolist()
    return rows + [(1000 + i, same, 1) for i in range(30)]


def test_clusters(spark, clustered):
    check(clustered, got(frame(spark, clustered)), 0.95)


def test_hot_keys_are_dealt_in_blocks_to_the_same_result(spark, clustered):
    assert got(frame(spark, clustered), bucket=16) == got(frame(spark, clustered), bucket=100_000)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 1), (9, [1.0, -0.0], 1), (10, [1e30, 1e25], 1), (11, [1.0], 1), (12, [1.0, 0.0], 2), (13, [2.0], 1)]
    out = got(frame(spark, rows))
    assert {i: v for i, v in out.items() if v[0] == 0} == {i: (0, i, True) for i in (1, 2, 3, 4, 5, 6, 7, 12)}
    assert out[8] == (2, 8, True) and out[9] == (2, 8, False) and out[10][:2] == (2, 8)
    assert out[11] == (1, 11, True) and out[13] == (1, 11, False)
    assert got(frame(spark, rows).limit(0)) == {}


def test_decode_lists_every_filter_over_the_bar():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((20, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    book = C.code(24, 3, 8)
    for v, found in zip(x, C.decode(x, book, 0.3), strict=True):
        parts = np.split(v, 3)
        want = [i * 64 + j * 8 + k for i in range(8) for j in range(8) for k in range(8) if parts[0] @ book[0][i] + parts[1] @ book[1][j] + parts[2] @ book[2][k] >= 0.3 * np.sqrt(3)]
        assert found.tolist() == want


@pytest.mark.parametrize("dims, zeros", [(2, 0), (16, 0), (64, 0), (64, 32), (256, 0), (768, 0), (768, 700)])
def test_recall_at_any_width(spark, dims, zeros):
    """Pairs at a cosine of about 0.935; the last ``zeros`` components are 0."""
    rng, rows = np.random.default_rng(dims + zeros), []
    for _ in range(150):
        a, b = rng.standard_normal((2, dims - zeros))
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        b = 0.935 * a + np.sqrt(1 - 0.935**2) * b / np.linalg.norm(b)
        rows += [(len(rows) + k, [*v.tolist(), *[0.0] * zeros], 1) for k, v in enumerate((a, b))]
    links, _ = brute(rows)
    out = got(frame(spark, rows))
    assert len(links) >= 150 and sum(v[0] for v in out.values()) >= 0.95 * 2 * len(links)


def test_few_random_pairs_meet_in_a_filter():
    """The filters part random vectors: under 3 in 100 pairs share one at 64 dimensions."""
    x = np.random.default_rng(8).standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    held = [set(f.tolist()) for f in C.filters(x, C.BLOCKS, C.WORDS, None, C.LEAST)]
    assert sum(bool(a & b) for a, b in combinations(held, 2)) < 0.03 * 400 * 399 / 2
    assert 10 < np.mean([len(h) for h in held]) < 40


def test_a_large_label(spark):
    """20,000 vectors of one label at 96 dimensions, some in pairs and one group of 500 near one centre."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((20_000, 96))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(0, 2000, 2):
        other = x[k + 1] - x[k] * (x[k] @ x[k + 1])
        x[k + 1] = 0.94 * x[k] + np.sqrt(1 - 0.94**2) * other / np.linalg.norm(other)
    x[2000:2500] = x[2000] + rng.standard_normal((500, 96)) * 0.018
    x = x.astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = np.zeros(len(x), int)
    for at in range(0, len(x), 1000):
        want[at : at + 1000] = (u[at : at + 1000] @ u.T >= C.COSINE).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    out = got(df, bucket=256)
    n = np.array([out[i][0] for i in range(len(x))])
    assert (n <= want).all() and n.sum() >= 0.97 * want.sum() and want.sum() > 10_000


@pytest.mark.parametrize("dims", [1, 2, 3, 64, 300])
def test_every_vector_has_its_nearest_filters(dims):
    x = np.random.default_rng(5).standard_normal((300, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = C.filters(x, C.BLOCKS, C.WORDS, 2.0, C.LEAST)
    least = C.few_of(C.code(dims, min(2, dims), C.WORDS), C.LEAST)
    assert min(map(len, found)) >= least and (dims == 1 or np.mean([len(f) for f in found]) < 2 * least)
