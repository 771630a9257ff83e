"""Approximate search against the exact one."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.operators import search as s
from codeloom.operators import vector_index as vi
from codeloom.operators import vectors
from codeloom.sources.scratch import scratch_folder
from codeloom.sources.tables import read_table


@pytest.fixture(scope="module")
def table(spark):
    return read_table(spark, "/root/testdata/sf0.1", "embeddings").select("vec_id", "embedding")


@pytest.fixture(scope="module")
def index(spark, table):
    return vi.build(table, "embedding", "vec_id", scratch_folder(spark))


def asked(table):
    return table.where("vec_id % 20 = 0").withColumnsRenamed({"vec_id": "q", "embedding": "qv"})


def test_recall_and_exact_search(spark, table, index):
    true = vectors.knn_blocks(table, "embedding", "vec_id", asked(table), "qv", "q", 10).cache()
    found = vi.search(index, asked(table), "qv", "q", 10, "vec_id")
    assert vi.recall(found, true, "q", "vec_id") >= 0.9
    for block in (1024, 30):
        exact = vi.search(index, asked(table), "qv", "q", 10, "vec_id", exact=True, block=block)
        key = lambda df: sorted((r.q, r["rank"], r.vec_id, round(r.score, 6)) for r in df.collect())
        assert key(exact) == key(true)
    again = vi.load(spark, index.path)
    assert np.array_equal(again.centroids, index.centroids) and again.slots == index.slots
    assert vi.search(again, asked(table).where("q = 0"), "qv", "q", 3, "vec_id").count() == 3


def test_only_probed_cells_and_slots_are_read(spark, table, index):
    one = asked(table).where("q = 40")
    plan = vi.search(index, one, "qv", "q", 5, "vec_id", probes=2)._jdf.queryExecution().toString()
    filters = [x for x in plan.split("PartitionFilters: ")[1:] if "cell" in x.split("]")[0]]
    assert filters and all(f.split("]")[0].count(",") <= 2 for f in filters)
    among = table.where("vec_id % 7 = 3")
    got = vi.search(index, one, "qv", "q", 5, "vec_id", exact=True, among=among).collect()
    want = vectors.knn_blocks(among, "embedding", "vec_id", one, "qv", "q", 5).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [r.vec_id for r in sorted(want, key=lambda r: r["rank"])]


def test_probes_follow_the_data():
    rng = np.random.default_rng(0)
    centre = rng.standard_normal((20, 16))
    clear = (np.repeat(centre, 50, 0) + rng.standard_normal((1000, 16)) / 20).astype(np.float32)[rng.permutation(1000)]
    none = rng.standard_normal((1000, 64)).astype(np.float32)
    assert vi.probes_for(clear, vi.centroids_of(clear, 20), 0.97) <= 3
    assert 10 <= vi.probes_for(none, vi.centroids_of(none, 20), 0.97) <= 20


def test_copies_and_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(400)] + [(1000 + i, rng.standard_normal(4).tolist()) for i in range(300)]
    rows += [(7, [1.0, 2.0, 3.0, 4.0]), (2000, [0.0] * 4), (2001, None), (2002, [1.0]), (2003, [1.0, None, 1.0, 1.0]), (None, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    index = vi.build(df, "v", "id", f"file://{tmp_path}/i", cells=8, sample=200, slot_rows=10)
    queries = spark.createDataFrame([(0, [1.0, 2.0, 3.0, 4.0]), (1, [0.0] * 4), (2, [1.0]), (3, [-4.0, 3.0, -2.0, 1.0]), (4, None)], "q long, qv array<double>")
    got = sorted((r.q, r["rank"], r.id) for r in vi.search(index, queries, "qv", "q", 5, exact=True).collect())
    true = vectors.knn_blocks(df.where("id is not null").select("id", F.col("v").cast("array<float>").alias("v")).distinct(), "v", "id", queries, "qv", "q", 5)
    assert got == sorted((r.q, r["rank"], r.id) for r in true.collect()) and got[:5] == [(0, k + 1, k) for k in range(5)]
    assert [r.id for r in vi.nearest(index, [1, 2, 3, 4], 3, probes=1).collect()] == [0, 1, 2]
    assert vi.search(index, queries.where("q = 1"), "qv", "q", 5).count() == 0
    empty = vi.build(df.where("false"), "v", "id", f"file://{tmp_path}/e")
    assert vi.search(empty, queries, "qv", "q", 5).count() == 0


def test_search_requests_with_candidates(spark, tmp_path):
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, "red fox" if i % 2 else "blue sky", rng.standard_normal(8).tolist()) for i in range(200)], "id long, text string, vec array<double>")
    index = vi.build(docs, "vec", "id", f"file://{tmp_path}/i", cells=4)
    vector = tuple(docs.where("id = 5").first().vec)
    ids = lambda dense: [(r.id, round(r.score, 6)) for r in s.search([docs], s.SearchRequest(match=(s.MatchText(("text",), "red"), s.Fusion(0.1, 0.9), dense))).hits.collect()]
    assert ids(s.MatchDense("vec", vector, 5)) == ids(s.MatchDense("vec", vector, 5, index=index, num_candidates=100, probes=4))
    assert ids(s.MatchDense("vec", vector, 5, index=index))[0][0] == 5


def test_scores_of_rows_by_queries_are_never_all_held(spark, monkeypatch):
    """A batch of 8,000 rows and a block of 1,000 queries: no more than some thousand rows are multiplied at once."""
    tasks, kind = [], type(spark.range(1))
    real = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, run, schema: (tasks.append(run), real(self, run, schema))[1])
    rows = spark.range(8000, numPartitions=1).select((F.col("id") * 7 % 8000).alias("id"), F.array(F.sin("id").cast("float"), F.cos(F.col("id") * 3).cast("float"), F.lit(1.0).cast("float")).alias("vec"))
    queries = rows.where("id < 1000").withColumnRenamed("id", "query")
    found = vectors.knn_blocks(rows, "vec", "id", queries, "vec", "query", 3)
    assert found.count() == 3000 and found.where("query = id").count() == 1000
    tracemalloc.start()
    assert sum(len(b) for b in tasks[0](iter(rows.toArrow().combine_chunks().to_batches()))) == 3000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
