"""Every operator on odd rows, on clashing columns and on no rows."""

import pytest

from codeloom.llm import chat, decontamination, html_main, neardup, packing, quality, rules, secrets, sharding, substrings


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(0, "same words here same words here same words here same words"), (1, None), (None, "x"), (2, "")], "item_id long, text string")


OPERATORS = {
    "shard": lambda d, b: sharding.shard_by_bytes(d, 4),
    "rules": lambda d, b: rules.judge(d),
    "keep_good": lambda d, b: rules.keep_good(d),
    "secrets": lambda d, b: secrets.scan(d),
    "redact": lambda d, b: secrets.redact(d),
    "neardup": lambda d, b: neardup.near_duplicates(d),
    "keep_one": lambda d, b: neardup.keep_one(d),
    "pack": lambda d, b: packing.pack_documents(d),
    "substrings": lambda d, b: substrings.remove_repeats(d),
    "leaks": lambda d, b: decontamination.find_leaks(d, b),
    "remove_leaks": lambda d, b: decontamination.remove_leaks(d, b),
    "score": lambda d, b: quality.score(d, None, 0.5),
}
#: Rows out of the eleven odd ones; None: any number.
ROWS = {"shard": 11, "rules": 11, "secrets": 11, "redact": 11, "neardup": 11, "substrings": 11, "score": 11, "pack": None, "leaks": 3, "remove_leaks": 8, "keep_good": None, "keep_one": None}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, clashing, bench, name):
    for table in (odd, clashing):
        n = len(OPERATORS[name](table, bench).collect())
        assert ROWS[name] is None or n == ROWS[name]


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(odd, bench, name):
    assert OPERATORS[name](odd.where("false"), bench).collect() == []


def test_pass_through_keeps_columns(clashing, bench):
    for name in ("keep_good", "keep_one", "remove_leaks", "redact"):
        assert OPERATORS[name](clashing, bench).columns == clashing.columns
    for name in ("shard", "rules"):
        out = OPERATORS[name](clashing, bench)
        for column in ("__key", "__traits", "row", "t", "tie", "fp", "label"):
            assert {r[column] for r in out.select(column).collect()} == {"x"}


def test_clashing_columns_of_tables_that_are_learned_from(spark, clashing):
    labels = spark.createDataFrame([(5, 1, "x"), (6, 1, "x"), (7, 0, "x"), (9, 0, "x"), (8, 1, "x"), (2, 0, "x"), (None, 1, "x")], "doc_id long, quality int, text string").withColumnsRenamed({"text": "found"})
    model, share = quality.train(clashing, labels)
    assert share == 0.5 and quality.score(clashing, model).count() == 11
    pages = spark.createDataFrame([(i, "u", f"<body><nav>menu {i}</nav><article><p>{'text ' * 30}{i}</p></article>", "x") for i in range(8)], "page_id long, url string, html string, text string")
    assert html_main.extract(pages, html_main.train(pages)).count() == 8
    turns = spark.createDataFrame([(1, 0, "user", "a", "x", "x")] * 3, "conv_id long, turn long, role string, text string, own string, n string")
    assert [r.n_turns for r in chat.collapse(turns).collect()] == [1]


def test_tables_without_rows(spark):
    conv = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.collapse(conv).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_main.train(pages) is None and html_main.extract(pages, None).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality.train(docs, labels) == (None, 0.5)


def test_odd_pages(spark):
    net = html_main.Labeller()
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (None, "u", "<p>x"), (3, None, "<" * 1000), (3, "u", "<p>" * 5000), (4, "u", "<script>var x = '<p>'")], "page_id long, url string, html string")
    rows = html_main.extract(pages, net).collect()
    assert len(rows) == 6 and all(r.n_chars == len(r.text) for r in rows) and not rows[0].text and not rows[1].text
