"""Vector search: exact cosine ranking, centroids, sparse and multi-vector scores."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Stands for a null id, after all others.
NO_ID = np.iinfo(np.int64).max


def in_slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, len(batch), rows):
            yield batch.slice(first, rows)


def dot(a: Column, b: Column) -> Column:
    """In double precision; null where the lengths differ."""
    both = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero or null, or the lengths differ."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def similarity(a: Column, b: Column) -> Column:
    """Cosine brought to 0 to 1, as vector stores report it."""
    return (cosine(a, b) + 1) / 2


def vector_literal(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def centroid(df: DataFrame, vec: str) -> DataFrame:
    """One row with the mean of the vectors, element by element; sums combine before they move."""
    places = df.select(F.posexplode(vec).alias("pos", "v")).groupBy("pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return places.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("centroid"))


def has_direction(vec: str) -> Column:
    """Whether a vector has no null and is not zero."""
    return F.coalesce(F.forall(vec, lambda x: x.isNotNull()) & F.exists(vec, lambda x: x != 0), F.lit(False))


def knn(df: DataFrame, vec: str, query: Column, k: int, id_col: str, least: float = 0.0, condition: Column | None = None) -> DataFrame:
    """The k rows most similar to the query, with their score; rows are filtered before they are ranked. Vectors that have no direction, or another length, are not ranked."""
    rows = df if condition is None else df.where(condition)
    scored = rows.withColumn("score", similarity(F.col(vec), query)).drop(vec)
    return scored.where(F.col("score") >= least).orderBy(F.desc("score"), id_col).limit(k)


def knn_blocks(df: DataFrame, vec: str, id_col: str, queries: DataFrame, query_vec: str, query_id: str, k: int, block: int = 1024) -> DataFrame:
    """The k nearest rows of every query: (query_id, id, score, rank).

    Queries are taken in blocks of a bounded size. Each task multiplies its rows with a block and
    keeps its own k best for each query, so k rows a query and task move. Rows and queries that have
    no direction, or another length than the first query, are not ranked.
    """
    queries = queries.where(has_direction(query_vec))
    first = queries.select(F.size(query_vec)).first()
    if first:
        queries, df = (t.where((F.size(c) == first[0]) & has_direction(c)) for t, c in ((queries, query_vec), (df, vec)))
    n = -(-queries.count() // block)
    schema = f"{query_id} long, {id_col} long, score double"
    rows = df.select(F.col(id_col).cast("long").alias(id_col), F.col(vec).alias("__vec"))
    parts = []
    for b in range(n):
        own = queries.where(F.pmod(F.xxhash64(query_id), F.lit(n)) == b).select(F.col(query_id).cast("long"), query_vec).collect()
        if not own:
            continue
        names = np.array([r[0] for r in own])
        m = np.array([r[1] for r in own], np.float64)
        m /= np.linalg.norm(m, axis=1, keepdims=True)

        def run(batches, names=names, m=m):
            # Some thousand rows at a time: scores of a whole batch would be as many as its rows times the queries.
            score, ids = np.empty((len(m), 0)), np.empty((len(m), 0), np.int64)
            for batch in in_slices(batches, 1024):
                x = np.asarray(batch.column(1).flatten(), np.float64).reshape(len(batch), -1)
                score = np.concatenate((score, ((m @ x.T) / np.linalg.norm(x, axis=1) + 1) / 2), 1)
                ids = np.concatenate((ids, np.broadcast_to(np.asarray(batch.column(0).fill_null(NO_ID)), (len(m), len(batch)))), 1)
                order = np.lexsort((ids, -score.round(12)), axis=1)[:, :k]
                score, ids = (np.take_along_axis(c, order, 1) for c in (score, ids))
            if ids.size:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, ids.shape[1])), pa.array(ids.ravel(), mask=ids.ravel() == NO_ID), pa.array(score.ravel())], names=[query_id, id_col, "score"])

        parts.append(rows.mapInArrow(run, schema))
    if not parts:
        return df.sparkSession.createDataFrame([], schema + ", rank int")
    order = Window.partitionBy(query_id).orderBy(F.desc(F.round("score", 12)), id_col)
    return reduce(DataFrame.union, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def sparse_score(weights: Column, query: dict) -> Column:
    """Inner product of a MAP column with a sparse query."""
    terms = [F.coalesce(F.try_element_at(weights, F.lit(key)).cast("double"), F.lit(0.0)) * float(w) for key, w in query.items()]
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def max_sim(vectors: Column, queries: list[list[float]]) -> Column:
    """For each query vector the best inner product among the row's vectors, summed."""
    def best(q: Column) -> Column:
        return F.array_max(F.transform(vectors, lambda v: dot(v, q)))

    return reduce(lambda a, b: a + b, [best(vector_literal(q)) for q in queries])


def related(lists: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Several ranked lists in one: the first list that holds a key counts, its rank stays. Lists have columns keys and order."""
    tagged = [df.withColumn("src", F.lit(i)) for i, df in enumerate(lists)]
    first = Window.partitionBy(*keys).orderBy("src", *order)
    return reduce(DataFrame.unionByName, tagged).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
