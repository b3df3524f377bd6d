"""Loads: inserts, updates, refusals, repeated and lost runs."""

import pytest

from lodestone.operators.load import Publication, Run, plan

T = "trail_key string, trail_id string, slug string, name string, region string, reviewed_at string"
S = "production_key string, segment_id string, trail_key string, segment_name string, miles double, line array<struct<lon:double,lat:double>>, reviewed_at string"
LINE = [(-71.0, 44.0), (-71.1, 44.1)]


def trail(k, name="North", at="2024-01-01"):
    return (k, f"id-{k}", f"slug-{k}", name, "East", at)


def segment(k, t, line=LINE, miles=1.5):
    return (k, f"id-{k}", t, f"name {k}", miles, line, "2024-01-01")


def load(spark, store, trails, segments, run):
    return store.load(spark.createDataFrame(trails, T), spark.createDataFrame(segments, S), run)


@pytest.fixture
def store(spark, tmp_path):
    s = Publication(spark, str(tmp_path / "store"))
    assert load(spark, s, [trail("t1"), trail("t2")], [segment("s1", "t1"), segment("s2", "t2")], Run("f1", "v1")) == "loaded"
    return s


def keys(df, key):
    return sorted(r[key] for r in df.collect())


def test_first_load_and_an_empty_store(spark, tmp_path, store):
    assert Publication(spark, str(tmp_path / "none")).read("segments").count() == 0
    assert keys(store.read("segments"), "production_key") == ["s1", "s2"]
    assert {r.publication_artifact_fingerprint for r in store.read("trails").collect()} == {"f1"}


def test_a_repeated_run_changes_nothing(spark, store):
    before = store.version()
    assert load(spark, store, [trail("t1")], [segment("s1", "t1")], Run("f1", "v1")) == "unchanged"
    assert store.version() == before


def test_a_known_fingerprint_updates_its_row_of_the_ledger(spark, store):
    old = store.read("runs").collect()
    assert load(spark, store, [trail("t1")], [segment("s1", "t1")], Run("f1", "v2")) == "loaded"
    new = store.read("runs").collect()
    assert len(new) == 1 and new[0].publication_run_id == old[0].publication_run_id and new[0].algorithm_version == "v2"


def test_a_second_run_updates_and_inserts(spark, store):
    # A line in the other direction is the same line; miles may change.
    assert load(spark, store, [trail("t1", at="2024-02-02")], [segment("s1", "t1", LINE[::-1], 2.5), segment("s3", "t2")], Run("f2", "v1")) == "loaded"
    rows = {r.production_key: (float(r.miles), r.publication_artifact_fingerprint) for r in store.read("segments").collect()}
    assert rows == {"s1": (2.5, "f2"), "s2": (1.5, "f1"), "s3": (1.5, "f2")}
    assert {r.trail_key: r.reviewed_at for r in store.read("trails").collect()} == {"t1": "2024-02-02", "t2": "2024-01-01"}
    assert keys(store.read("runs"), "artifact_fingerprint") == ["f1", "f2"]


@pytest.mark.parametrize(
    "trails, segments, message",
    [
        ([trail("t1", name="South")], [], "trail_conflict:t1"),
        ([trail("t1")], [segment("s1", "t1", [(-71.0, 44.0), (-71.2, 44.1)])], "segment_conflict:s1"),
        ([trail("t1")], [segment("s1", "t2")], "segment_conflict:s1"),
        ([trail("t1")], [segment("s9", "gone")], "trail_unknown:gone"),
        ([trail("")], [], "trail_key_missing"),
        ([trail("t1")], [segment(None, "t1")], "segment_key_missing"),
        ([trail("t1"), trail("t1")], [], "trail_repeated:t1"),
        ([trail("t1")], [segment("s8", "t1"), segment("s8", "t1")], "segment_repeated:s8"),
    ],
)
def test_refusals_change_nothing(spark, store, trails, segments, message):
    before = store.version()
    with pytest.raises(ValueError, match=message):
        load(spark, store, trails, segments, Run("f9", "v1"))
    assert store.version() == before and keys(store.read("runs"), "artifact_fingerprint") == ["f1"]


def test_demo_runs_and_runs_without_fingerprint_are_refused(spark, store):
    for run in (Run("f", "v1", demo_only=True), Run("", "v1")):
        with pytest.raises(ValueError):
            load(spark, store, [trail("t1")], [], run)


def test_a_lost_run_leaves_no_trace_and_is_taken_up(spark, store, monkeypatch):
    monkeypatch.setattr(Publication, "switch", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        load(spark, store, [trail("t3")], [], Run("f3", "v1"))
    assert keys(store.read("trails"), "trail_key") == ["t1", "t2"]
    monkeypatch.undo()
    assert load(spark, store, [trail("t3")], [], Run("f3", "v1")) == "loaded"
    assert keys(store.read("trails"), "trail_key") == ["t1", "t2", "t3"]
    assert store.vacuum(keep=1) == 2
    assert keys(store.read("trails"), "trail_key") == ["t1", "t2", "t3"]


def test_of_two_runs_at_once_one_wins(spark, store):
    number, version = store.version()
    store.switch(number + 1, version)
    with pytest.raises(Exception, match="exist"):
        store.switch(number + 1, version)


def test_plan_tells_nulls_apart(spark):
    old = spark.createDataFrame([("a", None), ("b", "x")], "k string, v string")
    new = spark.createDataFrame([("a", None), ("b", None), ("c", "x")], "k string, v string")
    assert {r.k: r.action for r in plan(old, new, "k", ("v",)).collect()} == {"a": "update", "b": "refuse", "c": "insert"}


def test_lines_agree_as_they_are_reversed_and_rounded(spark):
    """Only lines that differ as they are get texts; what agrees stays the same."""
    a, b, near, far = (-71.0, 44.0), (-71.1, 44.1), (-71.1 + 1e-9, 44.1), (-71.1, 44.2)
    t = "k string, line array<struct<lon:double,lat:double>>"
    old = spark.createDataFrame([("same", [a, b]), ("turned", [a, b]), ("rounded", [a, b]), ("turned and rounded", [a, b]), ("moved", [a, b]), ("both missing", None), ("missing", None)], t)
    new = spark.createDataFrame([("same", [a, b]), ("turned", [b, a]), ("rounded", [a, near]), ("turned and rounded", [near, a]), ("moved", [a, far]), ("both missing", None), ("missing", [a, b])], t)
    made = plan(old, new, "k", ("line",))
    assert {r.k for r in made.where("action = 'refuse'").collect()} == {"moved", "missing"} and made.count() == 7
