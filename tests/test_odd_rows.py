"""Rows that ordinary data has and that must not end a query."""

import datetime as dt

from pyspark.sql import functions as F

from codeloom.functions import embedding
from codeloom.functions import text as t
from codeloom.operators import code_search, vectors
from codeloom.operators import repos as r
from codeloom.operators import search as s


def test_vectors_without_direction(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [0.0, 2.0]), (6, [1.0, None]), (7, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    assert [(x.id, x.score) for x in vectors.knn(df, "vec", vectors.vector_literal([1, 0]), 9, "id").collect()] == [(1, 1.0), (5, 0.5), (7, 0.0)]
    assert vectors.knn(df, "vec", vectors.vector_literal([0, 0]), 9, "id").count() == 0
    queries = df.where("id in (1, 2, 3, 6)").withColumnsRenamed({"id": "q", "vec": "qv"})
    got = vectors.knn_blocks(df, "vec", "id", queries, "qv", "q", 9).collect()
    assert sorted((x.q, x.id, x["rank"]) for x in got) == [(1, 1, 1), (1, 5, 2), (1, 7, 3)]
    assert vectors.knn_blocks(df, "vec", "id", queries.where("q = 2"), "qv", "q", 9).count() == 0


def test_blank_texts_from_embedder_to_search(spark):
    texts = ["open a socket", "", "   ", "close the file", None]
    rows = spark.createDataFrame([(f"c{i}", "r", kind, f"f{i}", 1, 5, x) for i, x in enumerate(texts) for kind in ("line_chunk_vector", "symbol_summary_vector")], "id string, repo_id string, analysis_type string, file_path string, start_line int, end_line int, content string")
    space = embedding.embed(rows.fillna({"content": ""}), "content")
    assert [x.file_path for x in code_search.similar_code(space, "r", "open a socket", 10).collect()][0] == "f0"
    assert {x.file_path for x in code_search.related_files(space, space, "r", ["close the file"], 10).collect()} == {"f0", "f3"}
    hits = s.search([space], s.SearchRequest(match=(s.MatchDense("vec", tuple([0.0] * 64), 3),)))
    assert hits.total() == 0


def test_arrays_without_values(spark):
    df = spark.createDataFrame([("a", [3, 1, 2]), ("b", []), ("c", None), ("d", [None]), ("e", [4, None])], "id string, n array<int>")
    want = {"min": [1, 4], "max": [3, 4], "sum": [6, 4], "avg": [2, 4], "median": [2, 4]}
    for mode, (a, e) in want.items():
        got = {x.id: x.v for x in df.select("id", s.reduced(F.col("n"), mode).alias("v")).collect()}
        assert got == {"a": a, "b": None, "c": None, "d": None, "e": e}, mode
        request = s.SearchRequest(order_by=(s.SortField("n", True, mode),))
        assert [x.id for x in s.search([df], request).hits.collect()] == [*(["e", "a"] if mode == "sum" else ["a", "e"]), "b", "c", "d"]


def test_escapes_that_are_none(spark):
    df = spark.createDataFrame([("file:///a%zz b",), ("file:///a%20b%",), ("file:///%e4%b8%ad%2",), ("file:///x%25y+z",), (None,)], "u string")
    assert [x.p for x in df.select(t.uri_path(F.col("u")).alias("p")).collect()] == ["/a%zz b", "/a b%", "/中%2", "/x%y+z", None]


def test_accounts_that_repeat(spark):
    kind = "id string, user_id string, provider string, is_active boolean, created_at timestamp, updated_at timestamp"
    now = dt.datetime(2024, 1, 9)
    auths = spark.createDataFrame([("1", "u", "github", True, now, now), ("0", "u", "github", False, now, now)], kind)
    new = spark.createDataFrame([("2", "u", "github"), ("3", "u", "github"), ("5", "u", "gitlab"), ("4", "u", "gitlab"), ("6", None, "gitlab")], "id string, user_id string, provider string")
    saved = r.save_auth(auths, new, F.lit(now))
    assert sorted((x.id, x.is_active) for x in saved.collect()) == [("0", False), ("1", True), ("4", True)]
