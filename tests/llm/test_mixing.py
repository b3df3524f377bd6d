from collections import defaultdict

import pytest

from lodestone.llm import mixing as M

from ..oracle import compare, database
from .cases import ODD, frame

SOURCES = ("web", None, "books", "é", "code")


def test_query_gives_the_rows_of_its_sql(spark, sf):
    assert compare(M.op9_source_mix(spark, sf), database(sf), M.OP9_SQL) > 0


def rows(n=3000):
    return [(i, "w " * (i % 37) if i % 50 else "w " * 3000) for i in range(n)]


@pytest.mark.parametrize("cell", [50, 100_000])
def test_taken_words_come_near_the_targets(spark, cell):
    out = M.mix(frame(spark, rows(), SOURCES), cell_rows=cell).collect()
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in out:
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.target
    assert len(out) == 3000 and len(target) == 5
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    for s in target:
        assert target[s] <= 3 * size[s] + 1e-6
        assert abs(taken[s] - target[s]) < 0.06 * target[s] + 3000
    weight = dict(zip(sorted((s for s in target if s), key=lambda s: s.encode()), (1, 2, 3, 1), strict=True)) | {None: 2}
    free = [target[s] / weight[s] for s in target if target[s] < 3 * size[s] - 1e-6]
    assert max(free) == pytest.approx(min(free))


def test_reruns_agree(spark):
    one, two = (sorted(map(repr, M.mix(frame(spark, rows(500), SOURCES).repartition(k)).collect())) for k in (1, 7))
    assert one == two


def test_odd_rows(spark):
    out = M.mix(frame(spark, ODD, SOURCES)).collect()
    assert len(out) == len(ODD)
    assert all(r.size == 0 for r in out if r.doc_id in (1, 2, 3))
    assert M.mix(frame(spark, ODD).limit(0)).collect() == []
    nothing = M.mix(frame(spark, [(1, None), (2, "")])).collect()
    assert all(r.target == 0 and r.taken == 0 for r in nothing)


def test_what_a_small_source_cannot_fill_is_shared_again(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 1)], "source string, size long")
    got = {r.source: r.target for r in M.source_targets(sizes).collect()}
    assert got == {"a": pytest.approx(78), "b": 30.0, "c": 3.0}


def test_emit_repeats_documents(spark):
    docs = frame(spark, [(i, "w " * (i + 1)) for i in range(30)], ("x", "y"))
    want = {r.doc_id: r.copies for r in M.mix(docs).collect() if r.copies}
    got = defaultdict(int)
    out = M.emit(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        got[r.doc_id] += 1
    assert dict(got) == want


def test_mixed_keeps_rows_that_repeat_ids_apart(spark):
    odd = [*ODD, (5, "five words are in here"), (None, "x"), (None, "a row without an id")]
    docs = frame(spark, odd, SOURCES).withColumn("row", M.F.lit(1)).withColumn("copies", M.F.lit("y"))
    out = M.mixed(docs)
    rows_ = out.collect()
    assert len(rows_) == len(odd) and set(out.columns) == set(docs.columns) | {"source_size", "target", "taken"}
    assert sorted((r.doc_id or 0, r.text or "") for r in rows_) == sorted((i or 0, t or "") for i, t in odd)
    assert all(r.size == len((r.text or "").split()) and r.taken == r.copies * r.size for r in rows_ if (r.text or "").isascii())
    assert M.mixed(docs.limit(0)).collect() == [] and M.emit(docs.limit(0)).collect() == []
