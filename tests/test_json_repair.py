"""Goldens of faults that models make, and every beginning of valid JSON."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.functions import text as t
from codeloom.functions.json_repair import repair

GOLDENS = [
    ('{"a": 1, "b": [true, null, -2.5e3]}', {"a": 1, "b": [True, None, -2500.0]}, "valid"),
    ("{a: 1, b-c: 'x'}", {"a": 1, "b-c": "x"}, "repaired"),
    ("{'it': 'it's here', \"q\": \"say \"hi\" now\"}", {"it": "it's here", "q": 'say "hi" now'}, "repaired"),
    ('{"a": [1, 2,], "b": {},}', {"a": [1, 2], "b": {}}, "repaired"),
    ('{"a": 1 "b": 2}', {"a": 1, "b": 2}, "repaired"),
    ('{"a": True, "b": None, "c": .5, "d": plain words}', {"a": True, "b": None, "c": 0.5, "d": "plain words"}, "repaired"),
    ('{"a": "line\nnext", // why\n "b": /* x */ 2}', {"a": "line\nnext", "b": 2}, "repaired"),
    ('{"a": [1, 2}', {"a": [1, 2]}, "repaired"),
    ('{"a": "x" "b": 2}', {"a": "x", "b": 2}, "repaired"),
    ('{"a": , "b": 2}', {"a": None, "b": 2}, "repaired"),
    ('{"a": 1} and so on', {"a": 1}, "repaired"),
    ('{"path": "C:\\\\x", "u": "\\u00e9\\ud83d\\ude00"}', {"path": "C:\\x", "u": "é😀"}, "valid"),
    ("{“a”: “b”}", {"a": "b"}, "repaired"),
    ('{"a": {"b": [1, {"c": "d', {"a": {"b": [1, {"c": "d"}]}}, "truncated"),
    ('{"a":', {"a": None}, "truncated"),
    ('{"a": tr', {"a": None}, "truncated"),
    ("", None, "failed"),
    ("]}", None, "failed"),
]


@pytest.mark.parametrize("text,value,status", GOLDENS)
def test_goldens(text, value, status):
    got = repair(text)
    assert (got.value, got.status) == (value, status)


def test_places():
    assert repair('{"a": 1, b: 2}').at == 9 and repair('{"a": 1').at == 7 and repair('{"a": 1}x').at == 8 and repair('{"a": 1}').at == 8


values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4), max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(values, st.booleans())
def test_valid_json_is_read_as_it_is(value, ascii_):
    text = json.dumps(value, ensure_ascii=ascii_)
    got = repair(text)
    assert got.value == json.loads(text) and got.status == "valid", text


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text(), values, max_size=4))
def test_every_beginning_is_truncated(value):
    text = json.dumps(value)
    for i in range(1, len(text)):
        got = repair(text[:i])
        assert got.status == "truncated" and isinstance(got.value, dict), text[:i]
        parsed = t.parse_arguments(text[:i])
        assert parsed["error"] == "truncated"
    assert t.parse_arguments(text) == value


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["{", "}", "[", "]", ",", ":", '"', "'", "a", "1", "true", "\\", "\n", " ", "//", "é", "\\u12"]), max_size=25).map("".join))
def test_anything_ends(text):
    got = repair(text)
    assert got.status in ("valid", "repaired", "truncated", "failed") and 0 <= got.at <= len(text)
    json.dumps(got.value)
    json.dumps(t.parse_arguments(text))


def test_deep_and_long():
    deep = repair("[" * 50_000)
    assert deep.status == "truncated"
    assert repair('{"a": "' + "x" * 300_000 + '"}').status == "valid" and repair("[" + "1," * 100_000 + "1]").status == "valid"


def test_columns(spark):
    df = spark.createDataFrame([('```json\n{"a": 1,}\n```',), ('"{\\"a\\": 2}"',), ("{'a': 3",), ("no object",), (None,)], "x string")
    got = [json.loads(r.y) for r in df.select(t.arguments(F.col("x")).alias("y")).collect()]
    assert got == [{"a": 1}, {"a": 2}, {"error": "truncated", "raw": "{'a': 3", "at": 7, "partial": {"a": 3}}, {"error": "failed", "raw": "no object"}, {}]
