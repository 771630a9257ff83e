import pandas as pd
import pytest
from pyspark.sql import functions as F

from codeloom import schema
from codeloom.functions import text as t


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first().x


def test_scalars(spark):
    c = F.col("v")
    assert one(spark, t.normalize_path(c), v="a\\b/c") == "a/b/c"
    assert one(spark, t.fold_path(c), v="a/./b/../c") == "a/c"
    assert one(spark, t.language(c), v="x/Y.PY") == "python"
    assert one(spark, t.language(c), v="Makefile") == "unknown"
    assert one(spark, t.directory(c), v="a/b/c.py") == "a/b"
    assert one(spark, t.has_chinese(c), v="a中b") is True
    assert one(spark, t.is_ascii_letters(c), v="Ab c\n") is True
    assert one(spark, t.shift_headings(c, 1), v="# a\n###### b\ntext") == "## a\n###### b\ntext"
    assert one(spark, t.to_float(c), v="x") == float("-inf")
    assert one(spark, t.strip_thoughts(c), v="<think>x</think> ok") == "ok"
    assert one(spark, t.retryable(c), v="HTTP 429: slow down") is True
    assert one(spark, t.fallback_summary(F.lit("f: "), c), v="\n a \n\n b\nc\nd\ne") == "f: a b c d"


def test_stable_id(spark):
    parts = [F.lit(x) for x in ("r1", "app/a.py", "line_chunk_vector", 1, 5, "0")]
    assert one(spark, t.stable_id(*parts), v=1) == "851fc643c124325085c6139f19f49c11b322426d"


def test_context_size(spark):
    tokens = t.cheap_tokens(F.col("v")) + 4
    assert one(spark, tokens, v="héllo") == 10
    assert one(spark, t.context_size(tokens), v="héllo") == 8192


@pytest.mark.parametrize(
    ("url", "want"),
    [("https://GitHub.com/org/name.git", ("github", "org", "name")), ("git@gitlab.com:o/n", ("gitlab", "o", "n")), ("https://example.org/one", (None, "one", None))],
)
def test_git_parts(spark, url, want):
    row = spark.range(1).select(*[c.alias(k) for k, c in t.git_parts(F.lit(url)).items()]).first()
    assert tuple(row) == want


def test_ignored(spark):
    ask = lambda name, is_dir, p: one(spark, t.ignored(F.lit(name), F.lit(is_dir), p), v=1)
    assert ask("a.log", False, ["*.LOG"])
    assert not ask("build", False, ["build/"])
    assert ask("build", True, ["build/"])


def test_arguments():
    assert t.parse_arguments(None) == {} == t.parse_arguments("  ")
    assert t.parse_arguments('```json\n{"a": 1}\n```') == {"a": 1}
    assert t.parse_arguments('"{\\"a\\": 2}"') == {"a": 2}
    assert t.parse_arguments('{"a": [1, 2,],}') == {"a": [1, 2]}
    assert t.parse_arguments('{"a": {"b": 1')["error"] == "truncated"


def test_history(spark):
    rows = [
        (1, 0, "system", "s", None, None), (1, 1, "assistant", "a", ["x", "y", "z"], None), (1, 2, "tool", "r", None, "y"), (1, 3, "narrator", "n", None, None), (1, 4, "tool", "r", None, "never"),
        (1, 5, "assistant", "b", None, None), (2, 0, "tool", "early", None, "q"), (2, 1, "assistant", "c", ["q", "w", "v"], None), (2, 2, "tool", "late", None, "v"), (2, 3, "tool", "late", None, "q"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, call_ids array<string>, call_id string")
    got = {(r.conv_id, r.turn): (r.role, r.call_ids, r.call_id) for r in t.sanitized(turns).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (1, 5), (2, 1), (2, 2), (2, 3)}
    assert got[1, 1][1] == ["y"] and got[2, 1][1] == ["q", "v"] and got[1, 5][1] == [] and got[2, 2][2] == "v"


def test_calls_and_addresses(spark):
    calls = spark.createDataFrame([([("1", "f", '{"a": "é"}'), ("2", "g", "not json"), ("3", "h", None)],), ([],), (None,)], "calls array<struct<id:string,name:string,arguments:string>>")
    text = [r.x for r in calls.select(t.tool_calls(F.col("calls")).alias("x")).collect()]
    assert text[0].startswith('<tool_calls>\n<tool>\n{\n  "id": "1",\n  "name": "f",\n  "args": {\n    "a": "é"\n  }\n}\n</tool>\n') and text[0].endswith('"args": {}\n}\n</tool>\n</tool_calls>')
    assert '"args": "not json"' in text[0] and text[1:] == ["", ""]
    c = F.col("v")
    for value, want in (("file:///a%20b/../c+d.py?x=1", "/c+d.py"), ("file://host/x%2By", "/x+y"), ("rel/./z", "/base/rel/z"), ("\\a\\b", "/a/b")):
        assert one(spark, t.uri_path(c, "/base"), v=value) == want
    for value, want in (("Content-Length: 12\r\nX: 1", 12), ("X: 1\r\ncontent-length:7", 7), ("content-length: x", 0), ("", 0)):
        assert one(spark, t.content_length(c), v=value) == want
    assert one(spark, t.editor_language(c), v="a.TSX") == "typescriptreact" and one(spark, t.editor_language(c), v="a") == "plaintext"


def test_vocabulary(spark):
    from codeloom.functions import vocabulary

    own = vocabulary.encoding()
    for text in ("hello tokens of a text", "é中😀" * 5, "", None):
        ids = own.encode_ordinary(text or "")
        assert one(spark, vocabulary.n_tokens(F.col("v")), v=text) == len(ids)
        assert one(spark, vocabulary.cut(F.col("v"), 3), v=text) == (text if len(ids) <= 3 else own.decode_bytes(ids[:3]).decode("utf-8", "ignore"))


def test_typed(spark):
    df = spark.createDataFrame([("7", "2024-01-02", "x")], "n_int string, made_at string, title_tks string")
    row = schema.typed(df).first()
    assert row.n_int == 7 and row.made_at.year == 2024 and row.title_tks == "x"
    assert schema.type_of("q_1024_vec") == "array<float>" and schema.type_of("plain") is None
