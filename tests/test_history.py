import datetime
import random

import pytest

from lodestone.operators import history


def t(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=n)


def log_of(spark, rows):
    return spark.createDataFrame(rows, "k string, at timestamp, state string, n int")


@pytest.mark.parametrize("seed", range(3))
def test_intervals_and_as_of_against_plain_scans(spark, seed):
    r = random.Random(seed)
    # One key holds most rows; some times are shared, some states are null, some times lie on a day's edge.
    rows = [(r.choice(["hot", "hot", "hot", "a", "b"]), t(r.choice([r.randrange(9000), 1440, 2880])), r.choice(["x", "y", None]), i) for i in range(300)]
    want, last = [], {}
    for k, at, s, n in rows:
        last[k, at] = max(last.get((k, at), (-1, None)), (n, s), key=lambda v: v[0])
    for k in ("hot", "a", "b"):
        runs = []
        for (_, at), (_, s) in sorted((x for x in last.items() if x[0][0] == k), key=lambda x: x[0]):
            if not runs or runs[-1][1] != s:
                runs.append((k, s, at))
        want += [(*x, y[2] if y else None) for x, y in zip(runs, [*runs[1:], None])]
    got = [tuple(x) for x in history.intervals(log_of(spark, rows), ["k"], "at", "state", ["n"]).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)

    left = [(i, r.choice(["hot", "a", "none", None]), r.choice([t(r.randrange(12000)), t(1440), None])) for i in range(200)]
    asked = history.as_of(spark.createDataFrame(left, "i int, k string, at timestamp"), log_of(spark, rows), ["k"], "at", "state", ["n"])

    def plain(k, at):
        older = [(a, v) for (q, a), v in last.items() if q == k and at is not None and a <= at]
        return max(older, key=lambda x: x[0])[1][1] if older else None

    assert sorted(map(tuple, asked.select("i", "state").collect())) == [(i, plain(k, at)) for i, k, at in left]


def test_a_null_state_hides_the_one_before(spark):
    log = log_of(spark, [("k", t(0), "x", 0), ("k", t(3000), None, 1)])
    left = spark.createDataFrame([("k", t(10)), ("k", t(9000))], "k string, at timestamp")
    assert {x.at: x.state for x in history.as_of(left, log, ["k"], "at", "state").collect()} == {t(10): "x", t(9000): None}


def test_empty_logs(spark):
    log = log_of(spark, [])
    assert history.intervals(log, ["k"], "at", "state").count() == 0
    left = spark.createDataFrame([("k", t(1))], "k string, at timestamp")
    assert history.as_of(left, log, ["k"], "at", "state").collect()[0].state is None


def test_windows_run_inside_slices_of_a_key(spark):
    plan = history.as_of(spark.createDataFrame([("k", t(1))], "k string, at timestamp"), log_of(spark, []), ["k"], "at", "state")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "_slice" in text and "Cartesian" not in plan._jdf.queryExecution().executedPlan().toString()


def test_completions(spark):
    a = spark.createDataFrame([("a1", "u", "2024-01-02"), ("a2", "u", "2024-01-01"), ("a3", None, "2024-01-01")], "activity_key string, user_id string, completed_on string")
    m = spark.createDataFrame([("a1", "s", 0.9), ("a2", "s", 0.5), ("a3", "s", 0.5), ("gone", "s", 1.0), ("a1", "r", None)], "activity_key string, segment_key string, match_confidence double")
    e = spark.createDataFrame([("u", "s", "2024-01-01", "manual"), ("u", "q", None, "admin"), ("u", "p", "2024-01-01", "guess")], "user_id string, segment_key string, completed_on string, completion_method string")
    got = {(x.user_id, x.segment_key): (x.activity_key, x.completed_on, x.completion_method) for x in history.completions(a, m, e).collect()}
    assert got == {("u", "s"): (None, "2024-01-01", "manual"), ("u", "r"): ("a1", "2024-01-02", "gpx_match"), ("u", "q"): (None, None, "admin")}
