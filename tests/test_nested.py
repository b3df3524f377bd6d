import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import nested
from lodestone.operators.cleaning import PRIVATE


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def test_redaction_at_any_depth(spark):
    doc = {"a": [{"sourcePath": "data/x", "note": "data/x"}, ["/home/u/x", "ok"]], "folders": ["a\\b", {"other": "a\\b"}], "homely": "/homes/x", "n": 1, "z": "C:/x", "e": None, "b": True}
    got = json.loads(one(spark, json.dumps(doc), nested.redact_json))
    want = {"a": [{"sourcePath": PRIVATE, "note": "data/x"}, [PRIVATE, "ok"]], "folders": [PRIVATE, {"other": "a\\b"}], "homely": "/homes/x", "n": 1, "z": PRIVATE, "e": None, "b": True}
    assert got == want


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"b": 1.0, "a": {"d": 1e21, "c": 0.1}}', '{"a":{"c":0.1,"d":1e+21},"b":1}'),
        ("[1e-7, 0.000001, -0.0, 1e20, 123456789012345680000, 1.5e300]", "[1e-7,0.000001,0,100000000000000000000,123456789012345680000,1.5e+300]"),
        ('"\\ud800\\u001f\\u00e9"', '"\\ud800\\u001fé"'),
        ('{"a": 1, "a": 2}', '{"a":2}'),
        ("1e999", "null"),
        ("null", "null"),
        ("NaN", None),
        ("{", None),
        ("", None),
        (None, None),
        ("[" * 100_000 + "]" * 100_000, None),
    ],
)
def test_stable_text(spark, text, want):
    assert one(spark, text, nested.stable_text) == want


values = st.recursive(st.none() | st.booleans() | st.integers(-(2**53), 2**53) | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=12)


@settings(max_examples=200, deadline=None, suppress_health_check=list(HealthCheck))
@given(values)
def test_stable_text_is_json_of_the_same_value(v):
    text = nested._each(lambda x: x, json.dumps(v))
    assert json.loads(text, parse_int=float) == json.loads(json.dumps(v), parse_int=float)
    assert text == nested._each(lambda x: x, text)


def test_equality_elements_and_objects(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": [1, {"c": "x"}, null]}', '{"b": [1.0, {"c": "x"}, null], "a": 1}'), (2, '{"b": 3}', "{"), (3, None, "[]")], "id int, p string, q string")
    assert [r[0] for r in df.orderBy("id").select(nested.json_equal(F.col("p"), F.col("q"))).collect()] == [True, None, None]
    assert [(r.id, r.pos, r.element) for r in nested.elements(df, "p", "$.b").collect()] == [(1, 0, "1"), (1, 1, '{"c":"x"}'), (1, 2, None)]
    assert df.where("id = 1").select(nested.build_object(x=F.col("id"), y=F.lit(None).cast("string"))).first()[0] == '{"x":1,"y":null}'
