import zlib

import numpy as np
import pytest

from lodestone.llm import quality as Q
from lodestone.llm.linear import fit_hinge, margins

from .cases import ODD, frame

BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    return labels, Q.op5_quality(spark, BIG).collect()


def test_held_out_labels_are_told_apart(scored):
    labels, rows = scored
    away = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    pos, neg = [s for s, y in away if y == 1], [s for s, y in away if y == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert len(pos) > 5 and len(neg) > 5 and auc > 0.9
    assert np.mean([s >= 0.3 for s in pos]) > 0.9


def test_columns(scored):
    for r in scored[1]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_held_out_labels_are_never_used(spark):
    rows = [(i, f"good clear words {i}" if i % 2 else f"zzz spam !!! {i}") for i in range(200)]
    out = []
    for flip in (False, True):
        labels = spark.createDataFrame([(i, (i % 2) ^ (flip and zlib.crc32(str(i).encode()) % 5 == 0)) for i, _ in rows], "doc_id long, quality int")
        out.append(sorted((r.doc_id, r.score) for r in Q.score_quality(frame(spark, rows), Q.fit_quality(frame(spark, rows), labels)).collect()))
    assert out[0] == out[1]


def test_odd_rows_and_missing_labels(spark):
    docs = frame(spark, ODD)
    for labels in ([], [(5, 1)], [(5, 1), (8, 0), (7, None), (None, 1), (4, 7)]):
        model = Q.fit_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        got = Q.score_quality(docs, model).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
        assert Q.score_quality(docs.limit(0), model).collect() == []
        assert Q.keep_good(docs, model, threshold=0.0).count() == len(ODD)


def test_hinge_model_separates_what_is_separable():
    rng = np.random.default_rng(0)
    y = np.where(np.arange(100) % 2, 1.0, -1.0)
    rows = [(np.array([0, 1, 2]), np.array([v, *rng.standard_normal(2) * 0.1])) for v in y]
    assert (np.sign(margins(rows, fit_hinge(rows, y, 3, c=10))) == y).all()


def plain_buckets(text):
    """Hashes of all byte 2- to 4-grams, one by one."""
    data = (text or "").encode()
    return {((int.from_bytes(data[i : i + n], "little") + n) * 2654435761 % (1 << 32)) >> (32 - Q.BITS) for n in (2, 3, 4) for i in range(len(data) - n + 1)}


def test_ratios_and_scores_are_those_of_plain_counting(spark):
    rows = [(i, f"good clear words {i} of prose" if i % 3 else f"zzz spam !!! {i}") for i in range(150)]
    labels = [(i, int(i % 3 > 0)) for i, _ in rows]
    model = Q.fit_quality(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int"))
    learned = [(t, y) for (i, t), (_, y) in zip(rows, labels, strict=True) if zlib.crc32(str(i).encode()) % 5]
    n = np.array([sum(y == c for _, y in learned) for c in (0, 1)])
    for b in set().union(*(plain_buckets(t) for t, _ in learned)):
        count = [sum(y == c and b in plain_buckets(t) for t, y in learned[:]) for c in (0, 1)] if b % 50 == 0 else None
        if count:
            p = [(count[c] + 1) / (n[c] + 2) for c in (0, 1)]
            assert model.ratio[b] == pytest.approx(np.log(p[1] / p[0]))
    got = {r.doc_id: r.score for r in Q.score_quality(frame(spark, rows), model).collect()}
    for i, t in rows[:20]:
        own = sorted(plain_buckets(t))
        margin = sum(model.scaled[b] for b in own) / sum(model.ratio[b] ** 2 for b in own) ** 0.5 + model.bias
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(model.slope * margin + model.offset))), abs=1e-6)


def test_coordinate_descent_closes_the_gap_to_the_dual():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 8))
    y = np.sign(x[:, 0] + 0.5 * rng.standard_normal(200))
    w = fit_hinge([(np.arange(8), v) for v in x], y, 8, c=1.0, epochs=200)
    primal = 0.5 * w @ w + np.maximum(0, 1 - y * (x @ w[:8] + w[8])).sum()
    best = primal
    v = w.copy()
    for step in range(2000):  # plain subgradient steps from there find nothing much better
        bad = y * (x @ v[:8] + v[8]) < 1
        v = v - 0.001 / (1 + step / 200) * (v - np.append((y[bad, None] * x[bad]).sum(axis=0), y[bad].sum()))
        best = min(best, 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v[:8] + v[8])).sum())
    assert primal <= best * 1.01


def test_a_repeated_id_is_sampled_once_a_label(spark):
    rows = [(1, f"good clear words {i}") for i in range(300)] + [(i, f"zzz spam !!! {i}") for i in range(2, 60)]
    labels = spark.createDataFrame([(1, 1)] + [(i, 0) for i in range(2, 60)], "doc_id long, quality int")
    model = Q.fit_quality(frame(spark, rows), labels, fit_rows=20)
    assert all(0 <= r.score <= 1 for r in Q.score_quality(frame(spark, rows), model).collect())
