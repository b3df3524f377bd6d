"""Nested JSON text: private paths redacted at any depth, stable text, equality, elements and objects.

Documents nest without bound, which column functions can't follow, so a small Arrow function walks each one inside its
task, without a shuffle. Text that isn't JSON, or nests deeper than the walk can go, gives null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.cleaning import PATH_WORDS, PRIVATE, PRIVATE_ROOTS

_ABSOLUTE = re.compile(rf"[a-zA-Z]:[\\/]|/({'|'.join(PRIVATE_ROOTS)})\b", re.ASCII)
_NAMES_PATH = re.compile("|".join(PATH_WORDS), re.IGNORECASE)
_HALF = re.compile("[\ud800-\udfff]")


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def _number(x: float) -> str:
    """A double in its shortest form: whole ones without a point, exponents below 1e-6 and from 1e21 on; null if it is infinite."""
    if x != x or x in (float("inf"), float("-inf")):
        return "null"
    if x == 0:
        return "0"
    if not 1e-6 <= abs(x) < 1e21:
        digits, _, power = f"{Decimal(repr(x)).normalize():e}".partition("e")
        return f"{digits}e{int(power):+d}"
    text = f"{Decimal(repr(x)):f}"
    return text.rstrip("0").rstrip(".") if "." in text else text


def _string(s: str) -> str:
    return _HALF.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(s, ensure_ascii=False))


def _text(v: Any) -> str:
    if isinstance(v, dict):
        return "{" + ",".join(f"{_string(k)}:{_text(v[k])}" for k in sorted(v)) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(_text, v)) + "]"
    if isinstance(v, str):
        return _string(v)
    if isinstance(v, bool) or v is None:
        return {True: "true", False: "false", None: "null"}[v]
    return _number(v)


def _redact(v: Any, key: str = "") -> Any:
    """Items of an array stand under the array's key."""
    if isinstance(v, dict):
        return {k: _redact(x, k) for k, x in v.items()}
    if isinstance(v, list):
        return [_redact(x, key) for x in v]
    if isinstance(v, str) and (_ABSOLUTE.match(v) or (_NAMES_PATH.search(key) and ("/" in v or "\\" in v))):
        return PRIVATE
    return v


def _each(step: Callable[[Any], Any], text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return _text(step(json.loads(text, parse_int=float, parse_constant=_no_constant)))
    except (ValueError, OverflowError, RecursionError):
        return None


@F.pandas_udf(StringType())
def _stable(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _each(lambda v: v, t))


@F.pandas_udf(StringType())
def _redacted(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _each(_redact, t))


def stable_text(c: Column) -> Column:
    """JSON without blanks, keys of every object by code point, numbers as doubles in shortest form; the last of equal keys counts."""
    return _stable(c)


def redact_json(c: Column) -> Column:
    """``stable_text`` with private absolute paths at any depth replaced, and text with a slash under a key that names a path."""
    return _redacted(c)


def json_equal(a: Column, b: Column) -> Column:
    """Whether two documents hold the same values, whatever the order of keys; null if either is none."""
    return stable_text(a) == stable_text(b)


def elements(df: DataFrame, column: str, path: str = "$") -> DataFrame:
    """Rows of ``df`` with pos and element (text) of the array at ``path``; rows without one there give none."""
    found = F.from_json(F.try_variant_get(F.try_parse_json(column), path, "variant").cast("string"), "array<string>")
    return df.select("*", F.posexplode(found).alias("pos", "element"))


def build_object(**values: Column) -> Column:
    """JSON text of an object; nulls are written as null."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in values.items()]), {"ignoreNullFields": "false"})
