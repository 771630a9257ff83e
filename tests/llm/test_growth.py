"""Names, rows and groups that grow or clash."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import chat, neardup, packing, quality, rules, secrets


def test_columns_with_dots_and_names_of_results(spark, docs_of):
    docs = docs_of([(1, "password = hunter2000"), (2, "plain words"), (2, "plain words")]).withColumnsRenamed({"doc_id": "n_hex", "text": "a.b"})
    assert sorted((r.doc_id, r.n_assign) for r in secrets.scan(docs, "a.b", "n_hex").collect()) == [(1, 1), (2, 0), (2, 0)]
    out = secrets.redact(docs, "a.b")
    assert out.columns == docs.columns and {r[1] for r in out.collect()} == {"[SECRET]", "plain words"}
    assert sorted(r.component_id for r in neardup.near_duplicates(docs, "a.b", "n_hex").collect()) == [1, 2, 2]
    assert neardup.keep_one(docs, "a.b", "n_hex").count() == 2
    dotted = docs.withColumnRenamed("n_hex", "the.id")
    assert secrets.scan(dotted, "a.b", "the.id").columns[0] == "the.id"


def test_rows_that_differ_in_a_map_alone(spark):
    rows = [(1, "a b c d e", {"k": i}) for i in range(5)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>")
    kept = {tuple(r.m.items()) for n in (1, 2, 5) for r in neardup.keep_one(df.repartition(n)).collect()}
    assert len(kept) == 1


@pytest.mark.parametrize("lengths", [(4,), (1, 2, 5), (16,)])
def test_short_lengths_hold_any_character(spark, docs_of, lengths):
    texts = ["😀😃🙈" * 20, "é中文ß" * 30, "a" * 50, "mixed 😀 words and 中文 " * 10, "", None]
    docs = docs_of(list(enumerate(texts)))
    got = packing.pack_documents(docs, lengths=lengths).collect()
    for i, t in enumerate(texts):
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert "".join(r.text or "" for r in own) == (t or "")
        assert all(r.end - r.start <= max(lengths) for r in own) and [r.start for r in own[1:]] == [r.end for r in own[:-1]]
    with pytest.raises(ValueError, match="4 tokens"):
        packing.pack_documents(docs, lengths=(1, 2))


def test_pieces_of_rows_without_an_id_of_their_own(spark, docs_of):
    texts = [f"row {k} " + f"{'xyz'[k % 3]}{k} " * 40 for k in range(12)]
    docs = docs_of([(None if k % 3 else 7, t) for k, t in enumerate(texts)] + [(7, texts[0])])
    rows = sorted(packing.pack_documents(docs, lengths=(16, 32)).collect(), key=lambda r: (r.row_id, r.piece))
    whole = {}
    for r in rows:
        whole[r.row_id] = whole.get(r.row_id, "") + r.text
    assert sorted(whole.values()) == sorted([*texts, texts[0]])


def test_many_equal_rows_without_an_id(spark):
    """Rows that repeat are one before any window sees them."""
    one = spark.range(100_000).select(F.lit(None).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("hello").alias("text"))
    plan = chat.collapse(one)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and plan.rindex("Aggregate [") > plan.rindex("Window")
    assert [(r.n_turns, r.n_equal) for r in chat.collapse(one).collect()] == [(1, 1)]
    long = spark.createDataFrame([(1, k, "user", f"{k} " * 2000) for k in range(300)], "conv_id long, turn long, role string, text string")
    got = chat.collapse(long.union(long.where("turn < 200").withColumn("conv_id", F.lit(2)))).collect()
    assert [(r.conv_id, r.n_turns) for r in got] == [(1, 300)] and got[0].rendered.count("<|user|>") == 300


def test_a_bucket_of_far_fingerprints(spark):
    """50,000 that share a segment and no more, and some that link."""
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 1 << 48, 50_000, dtype=np.uint64) << np.uint64(16) | np.uint64(7)
    near = fps[:500] ^ np.uint64(1 << 20) ^ np.uint64(1 << 63)
    started = time.time()
    found = neardup.spanning_links(np.concatenate([fps, near]), 4)
    assert time.time() - started < 20
    pairs = {tuple(sorted((int(a), int(b)))) for x, y in found for a, b in zip(x, y, strict=True)}
    assert all(bin(a ^ b).count("1") <= 4 for a, b in pairs)
    assert {tuple(sorted((int(a), int(b)))) for a, b in zip(fps, near, strict=False)} <= pairs


def test_scores_at_the_edge(spark, docs_of):
    """0.7 itself is good enough; half a posterior keeps."""
    docs = docs_of([(1, "x"), (2, None)])
    assert [r.score for r in quality.score(docs, None, 0.7).collect()] == [0.7, 0.7]
    judged = rules.judge(docs_of([(k, "the same few words again and again " * 20) for k in range(4)])).collect()
    assert len({(r.kept, r.base_failed) for r in judged}) == 1


def test_blocks_of_the_benchmark_are_bounded_by_terms(spark, docs_of):
    from codeloom.llm import decontamination

    items = [(i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of([(i, "before it " + t + " and after it") for i, t in items[::3]] + [(100, "nothing of these " * 20)])
    for terms in (200_000, 300):
        sizes = [len(s.items.ids) for s in decontamination.searches(docs, bench, block_terms=terms)]
        assert sum(sizes) == 30 and (len(sizes) >= 4 if terms == 300 else len(sizes) == 1)
        assert {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, bench, block_terms=terms).collect()} == {(i, i) for i, _ in items[::3]}
