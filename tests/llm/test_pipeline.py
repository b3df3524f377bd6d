import corpus_pipeline as P
import pytest

from lodestone.llm import mixing, quality, secrets, tiling
from lodestone.llm.common import read

from .test_shingles import brute as jaccard_components

BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Input and output of each stage."""
    out, docs = {}, read(spark, sf, "documents")
    for name, f in P.STAGES:
        before, docs = docs, P.write_shared(f(spark, docs, sf))
        out[name] = before, docs
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_all_but_the_last_stage_return_documents(spark, sf, stages):
    columns = read(spark, sf, "documents").columns
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "mixture"]
    assert all(stages[n][1].columns == columns for n, _ in P.STAGES[:-1])


def test_quality_keeps_what_scores_well(spark):
    """On a table with enough labels of both kinds."""
    before, labels = read(spark, BIG, "documents"), read(spark, BIG, "labels")
    scores = quality.score_quality(before, quality.fit_quality(before, labels)).collect()
    after = P.quality(spark, before, BIG)
    assert ids(after) == sorted(r.doc_id for r in scores if r.predicted)
    assert 0 < after.count() < before.count()


def test_one_of_each_group_stays(stages):
    """Groups by brute-force Jaccard similarity of five-word shingles."""
    before, after = stages["near_duplicates"]
    comp = jaccard_components([(r.doc_id, r.text) for r in before.collect()])
    assert ids(after) == sorted(set(comp.values()))


def test_no_kept_document_covers_an_item(spark, sf, stages):
    before, after = stages["decontamination"]
    bench = read(spark, sf, "benchmark")
    bad = {r.doc_id for r in tiling.overlaps(before, bench).where("coverage >= 0.8").collect()}
    assert bad and ids(after) == [i for i in ids(before) if i not in bad]


def test_no_secret_is_left(stages):
    before, after = stages["secrets"]
    assert ids(after) == ids(before)
    assert secrets.scan(before).where("size(spans) > 0").count() > 0
    left = secrets.scan(after).where("size(spans) > 0").collect()
    assert left == []
    assert all(r.n_chars == len(r.text) for r in after.collect() if r.text is not None)


def test_the_mix_is_of_what_is_left(spark, sf, stages):
    before, after = stages["mixture"]
    text = {r.doc_id: r.text for r in before.collect()}
    out = after.collect()
    assert {r.doc_id: r.text for r in out} == text and len(out) == len(text)
    names = ["doc_id", "source", "size", "source_size", "target", "copies", "taken"]
    assert sorted(map(tuple, after.select(names).collect())) == sorted(map(tuple, mixing.mix(before).select(names).collect()))
    assert sorted(map(repr, P.run(spark, sf).select(after.columns).collect())) == sorted(map(repr, out))


EXTRA = {c: c for c in ("_id", "_rules", "rules", "row", "spans", "copies", "size", "target", "label", "component_id", "set", "held", "clean", "class", "part", "n", "a", "b")}


def test_stages_take_odd_and_empty_tables(spark, sf):
    docs = read(spark, sf, "documents")
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", None, 0), (2, "", "en", None, 0), (None, "some words", None, "s", 10), (None, None, None, None, None), (3, "token=" + "a1" * 20, "en", "s", 46)], docs.schema)
    for some in (odd, odd.limit(0)):
        n = some.count()
        some = some.withColumns({k: P.F.lit(v) for k, v in EXTRA.items()})
        columns = some.columns
        for name, f in P.STAGES:
            some = f(spark, some, sf)
            assert name == "mixture" or some.columns == columns
        rows = some.collect()
        assert len(rows) <= n and all(r._id == "_id" and r.spans == "spans" and r.component_id == "component_id" for r in rows)
        if n:
            assert {r.doc_id for r in rows} == {1, 3, None} and sum(r.doc_id is None for r in rows) == 2
            assert [r.text for r in rows if r.doc_id == 3] == ["[SECRET]"]
