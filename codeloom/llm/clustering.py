"""Centroid clustering with Hamerly's bounds, in whole numbers.

Every vector keeps its centroid, an upper bound of the distance to it and one lower bound of the
distance to any other. When centroids move, the bounds are loosened by how far, and only vectors whose
bounds overlap are compared with all centroids again, exactly. Bounds are rounded outwards, so the
assignment is the exact one, ties included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.sources.scratch import discard, materialize
from codeloom.sources.tables import read_table

#: Bounds are rounded outwards by this share, far more than a square root in double precision is off.
MARGIN = 1e-9
ROWS = 8192


def whole_vectors(vec: str, dims: int) -> Column:
    """Is this a vector of ``dims`` finite components? Others are not clustered."""
    column = F.col(f"`{vec}`")
    good = F.forall(column, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce((F.size(column) == dims) & good, F.lit(False))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), dims)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centroid, its squared distance, the least squared distance to another) of every row, in whole numbers; of equals the first centroid. Without another centroid the last is -1."""
    square = np.empty((len(x), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        d = x - c
        square[:, k] = np.einsum("ij,ij->i", d, d)
    own = square.argmin(1)
    rows = np.arange(len(x))
    least = square[rows, own].copy()
    square[rows, own] = np.iinfo(np.int64).max
    second = square.min(1) if len(centroids) > 1 else np.full(len(x), -1)
    return own, least, second


def _bounds(least: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.sqrt(least.astype(np.float64)) * (1 + MARGIN), np.where(second < 0, np.inf, np.sqrt(np.maximum(second, 0).astype(np.float64)) * (1 - MARGIN))


def loosened(own: np.ndarray, upper: np.ndarray, lower: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds after every centroid moved by ``drift``: the own one's adds to the upper bound, the largest of the others' goes off the lower one."""
    if len(drift) < 2:
        return upper + drift[own], lower
    first, second = np.argsort(-drift, kind="stable")[:2]
    other = np.where(own == first, drift[second], drift[first])
    return (upper + drift[own]) * (1 + MARGIN), (lower - other) - np.abs(lower) * MARGIN


def reassign(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(centroid, upper, lower) after a move, and how many vectors were compared with all centroids.

    Bounds that touch are ambiguous: another centroid might be as near and have a smaller number.
    An ambiguous vector's upper bound is tightened first, which takes one distance.
    """
    upper, lower = loosened(own, upper, lower, drift)
    open_ = np.flatnonzero(upper >= lower)
    d = x[open_] - centroids[own[open_]]
    upper[open_] = np.sqrt(np.einsum("ij,ij->i", d, d).astype(np.float64)) * (1 + MARGIN)
    open_ = open_[upper[open_] >= lower[open_]]
    own = own.copy()
    if len(open_):
        own[open_], least, second = nearest(x[open_], centroids)
        upper[open_], lower[open_] = _bounds(least, second)
    return own, upper, lower, len(open_)


def _sums(rows: DataFrame, dims: int, k: int) -> dict[int, tuple[int, list[int]]]:
    """What moves add to each centroid: (vectors, sum of components); joined in one, gone from the other. Each task hands over one row a centroid and a sum, and k of them reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            x = np.concatenate((np.ones((len(batch), 1), np.int64), _matrix(batch.column(0), dims).astype(np.int64)), 1)
            for column, sign in ((1, 1), (2, -1)):
                own = np.asarray(batch.column(column))
                for c in np.unique(own[own >= 0]).tolist():
                    total[c] += sign * x[own == c].sum(0)
        full = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(total[full].tolist(), pa.list_(pa.int64()))], names=["cluster", "s"])

    part = rows.select("x", "cluster", "before").mapInArrow(run, "cluster int, s array<bigint>")
    sums = part.groupBy("cluster").agg(*[F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims + 1)])
    return {r["cluster"]: (int(r["s0"]), [int(r[f"s{i}"]) for i in range(1, dims + 1)]) for r in sums.collect()}


def _assigned(rows: DataFrame, centroids: np.ndarray, drift: np.ndarray | None, dims: int) -> DataFrame:
    """The vectors with their centroid, the one before, and bounds; ``drift`` is None for the first time, when no vector has bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), ROWS):
                batch = whole.slice(first, ROWS)
                x = _matrix(batch.column(1), dims).astype(np.int64)
                if drift is None:
                    before = np.full(len(x), -1)
                    own, least, second = nearest(x, centroids)
                    upper, lower = _bounds(least, second)
                else:
                    before = np.asarray(batch.column(2))
                    own, upper, lower, _ = reassign(x, before, np.asarray(batch.column(3)), np.asarray(batch.column(4)), centroids, drift)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(own, pa.int32()), pa.array(before, pa.int32()), pa.array(upper), pa.array(lower)],
                    names=["id", "x", "cluster", "before", "upper", "lower"],
                )

    read = ["id", "x"] if drift is None else ["id", "x", "cluster", "upper", "lower"]
    return rows.select(*read).mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, x array<int>, cluster int, before int, upper double, lower double")


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, vec: str = "embedding", vec_id: str = "vec_id", dims: int = 64, scale: int = 64) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every vector, and the final centroids.

    Components become floor(scale * x). Vectors of another length, and those with a null or an
    infinite component or one that is no number, are left out. The first centroids are the k vectors
    whose ids have the smallest hashes, so with fewer vectors there are fewer; of repeated ids the
    vector with the smaller components comes first, and a null id is hashed as ''. Each round
    assigns all vectors and moves every centroid to the floor of its vectors' mean; one without
    vectors stays. Repeated rows give repeated results, other columns do not matter, and a table
    without vectors gives no rows. Components beyond 2^27 are an error, as squared distances would
    not fit 64 bits.

    A round's table is written from the one before, which is then deleted. Sums of components are
    kept and changed by the vectors that moved. The driver sees centroids and their sums alone.
    """
    x = F.transform(F.col(f"`{vec}`"), lambda v: F.floor(v.cast("double") * scale))
    fits = F.forall(x, lambda v: (v >= -(1 << 27)) & (v <= 1 << 27))
    x = F.when(fits, x.cast("array<int>")).otherwise(F.raise_error(F.lit("components beyond 2^27 do not fit exact distances")).cast("array<int>"))
    rows = df.where(whole_vectors(vec, dims)).select(F.col(f"`{vec_id}`").alias("id"), x.alias("x"))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    centroids = [list(r.x) for r in rows.select("x", key.alias("h")).orderBy("h", "x").limit(k).collect()]
    if not centroids:
        return rows.select(F.col("id").alias(vec_id), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    k = len(centroids)
    drift, assigned = None, rows
    counts, sums = [0] * k, [[0] * dims for _ in range(k)]
    for turn in range(rounds + 1):
        old = assigned
        assigned = materialize(_assigned(old, np.array(centroids, np.int64), drift, dims), f"assigned{turn}")
        discard(old)
        if turn == rounds:
            break
        for c, (n, s) in _sums(assigned.where("cluster <> before"), dims, k).items():
            counts[c] += n
            sums[c] = [a + b for a, b in zip(sums[c], s, strict=True)]
        moved = [[s // counts[c] for s in sums[c]] if counts[c] else centroids[c] for c in range(k)]
        square = [sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) for p, q in zip(centroids, moved, strict=True)]
        drift, centroids = np.sqrt(np.array(square, np.float64)) * (1 + MARGIN), moved
    final = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch.column(2))
            d = _matrix(batch.column(1), dims).astype(np.int64) - final[own]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.einsum("ij,ij->i", d, d), pa.int64())], names=[vec_id, "cluster", "distance"])

    kind = assigned.schema["id"].dataType.simpleString()
    return assigned.select("id", "x", "cluster").mapInArrow(run, f"`{vec_id}` {kind}, cluster int, distance long"), centroids


def op12_hamerly(spark, sf_dir: str) -> DataFrame:
    """All embeddings in 16 clusters after 3 rounds, with the inertia of each and of all."""
    found, centroids = cluster(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    about = [(c, each.get(c, 0), sum(each.values()), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)]
    table = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds(k: int, rounds: int) -> str:
    """The SQL of one assignment after another, and of the centroids in between."""
    out = []
    for r in range(rounds + 1):
        out.append(
            f"a{r} as (select row, vec_id, x, c, d from (select v.row, v.vec_id, v.x, m.c, list_sum(list_transform(list_zip(v.x, m.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as d from v, c{r} m) "
            "qualify row_number() over (partition by row order by d, c) = 1)"
        )
        if r < rounds:
            out.append(
                f"s{r} as (select c, i, sum(y)::hugeint as total, count(*) as n from (select c, unnest(x) as y, generate_subscripts(x, 1) as i from a{r}) group by c, i), "
                f"c{r + 1} as (select m.c, coalesce(n.x, m.x) as x from c{r} m left join "
                f"(select c, list(((total - ((total % n) + n) % n) // n)::bigint order by i) as x from s{r} group by c) n on n.c = m.c)"
            )
    return ",\n".join(out)


ORACLE_OP12 = f"""
with v as (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as x
  from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as (
  select row_number() over (order by h, x) - 1 as c, x from (select sha256('1:' || coalesce(vec_id::varchar, '')) as h, x from v)
  order by h, x limit 16),
{_rounds(16, 3)},
each as (select c, sum(d)::bigint as s from a3 group by c)
select a.vec_id, a.c::int as cluster, a.d::bigint as distance, e.s as cluster_inertia, (select sum(s)::bigint from each) as inertia,
  sha256(array_to_string(m.x, ',')) as centroid_sha256
from a3 a join each e on e.c = a.c join c3 m on m.c = a.c
"""
