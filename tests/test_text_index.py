"""Postings against the scan of whole texts."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import search as s
from codeloom.operators import text_index as ti
from test_positions import shuffled_rows

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa".split()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(0)
    text = lambda: " ".join(rng.choices(WORDS, [2**-k for k in range(10)], k=rng.randrange(9)))
    rows = [(f"d{i}", text(), text()) for i in range(900)] + [("null", None, None), ("odd", "ALPHA\t\nRare  rare", "ünï")]
    return spark.createDataFrame(rows, "key string, title string, body string")


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    return ti.build(docs, ["title", "body"], "key", f"file://{tmp_path_factory.mktemp('i')}", block=16, buckets=8)


def by_scan(docs, match):
    return {r.key: (r.matched_terms, round(r.text_score, 9)) for r in s.text_score(docs, match).collect()}


@pytest.mark.parametrize("fields", [("title",), ("title^2", "body"), ("body^0.5", "title")])
@pytest.mark.parametrize("text,share", [("alpha", 0), ("Beta KAPPA absent", 0), ("alpha beta gamma", 0.7), ("rare ünï", 1.0), ("absent", 0)])
def test_same_as_a_scan(docs, index, fields, text, share):
    match = s.MatchText(fields, text, share)
    want = by_scan(docs, match)
    assert {r.id: (r.matched_terms, round(r.text_score, 9)) for r in ti.scores(index, match).collect()} == want
    best = sorted(want, key=lambda i: (-want[i][1], i))
    for top in (1, 7, 100, 5000):
        got = [r.id for r in ti.scores(index, match, top).collect()]
        assert [want[i][1] for i in got] == [want[i][1] for i in best[:top]] and len(set(got)) == len(got)


def test_only_asked_words_are_read(spark, docs, index):
    match = s.MatchText(("title",), "kappa")
    plan = ti.scores(index, match)._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: ")[1].split("PushedFilters: ")
    assert f"= {ti.bucket_of('kappa', 8)})" in filters[0] and "EqualTo(term,kappa)" in filters[1].split("ReadSchema")[0]
    again = ti.load(spark, index.path)
    assert again == index
    rows = ti.matching(again, docs.select("key", F.lit(1).alias("one")), match, "key")
    assert rows.columns == ["key", "one", "matched_terms", "text_score"] and rows.count() == len(by_scan(docs, match))


def test_blocks_below_the_bound_stay_closed(spark, tmp_path):
    """Few documents have both words: blocks without one of these are not opened for the best."""
    rows = [(i, "common" + " rare" * (i % 500 == 0)) for i in range(20_000)]
    docs = spark.createDataFrame(rows, "id long, text string")
    index = ti.build(docs, ["text"], "id", f"file://{tmp_path}/i", block=50, buckets=4)
    match = s.MatchText(("text",), "common rare")
    assert [r.id for r in ti.scores(index, match, 5).collect()] == [0, 500, 1000, 1500, 2000]
    weights = {("text", "common"): s.idf(20_000, 20_000), ("text", "rare"): s.idf(20_000, 40)}
    bounds = ti._scores(index.of(["text"], match.words()).select("field", "term", "block"), "block", weights, match.words(), s.boosts(match))
    assert bounds.count() == 400 and bounds.where(F.col("text_score") >= sum(weights.values()) - 1e-9).count() <= 40


def test_odd_tables(spark, docs, tmp_path):
    rows = [(1, "a b"), (1, "c"), (None, "a"), (2, None), (3, "")]
    index = ti.build(spark.createDataFrame(rows, "id long, text string"), ["text"], "id", f"file://{tmp_path}/i")
    assert [(r.id, r.matched_terms) for r in ti.scores(index, s.MatchText(("text",), "a c")).collect()] == [(1, 2)] and index.n == 3
    assert ti.scores(index, s.MatchText(("text",), " ")).count() == 0
    empty = ti.build(docs.where("false"), ["title"], "key", f"file://{tmp_path}/e")
    assert ti.scores(empty, s.MatchText(("title",), "alpha"), 3).count() == 0 and empty.n == 0


def test_words_do_not_move_before_they_are_grouped(spark, tmp_path):
    docs = spark.range(200).selectExpr("id as key", "array_join(transform(sequence(1, 100), k -> concat('w', pmod(id * 31 + k, 400))), ' ') as body")
    index = []
    moved = shuffled_rows(spark, lambda: index.append(ti.build(docs, ["body"], "key", f"file://{tmp_path}/i", block=100, buckets=2)))
    postings = index[0].postings()
    assert postings.agg(F.sum("n")).first()[0] == 200 * 100 and moved <= postings.count() + 3 * 200


def test_cut_texts_score_like_whole_ones(docs):
    for match in (s.MatchText(("title^2", "body"), "alpha rare KAPPA none ünï", 0.4), s.MatchText(("body",), "eta", 0.0)):
        score = lambda df: sorted((r.key, r.matched_terms, r.text_score) for r in s.text_score(df, match).collect())  # noqa: E731, B023
        cut = s.only_words(docs, match)
        assert score(cut) == score(docs) and cut.agg(F.max(F.length("body"))).first()[0] <= len(match.text)
