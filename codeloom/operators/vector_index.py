"""Approximate vector search: an inverted file of cells with the residuals' codes, and exact scores for candidates.

Cells are the centroids of a bounded sample. Every row lies in the cell whose centroid is nearest by
angle, and what its direction differs from the centroid is kept as one byte a component, with the
length of the rounding error. A search looks at the cells nearest to each query, ranks their rows by
the codes, and takes exact scores of the best, whose vectors lie in a table of their own: of that one
only the slots of candidates are read. The errors bound every score from both sides, so a search
through all cells that keeps whatever the bounds allow is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.operators.vectors import has_direction, in_slices, similarity

#: What single precision may add to a score's error.
SLACK = 1e-5


@dataclass(frozen=True)
class VectorIndex:
    """An index in a folder: ``codes`` by cell and ``vectors`` by slot, a cell having ``slots`` of them; ``centroids`` are in memory, at most some thousands. ``probes`` is how many cells a search looks at unless told otherwise."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    slots: int
    probes: int

    def codes(self) -> DataFrame:
        return self.spark.read.schema("id long, same long, code binary, scale float, error float, slot int, cell int").parquet(f"{self.path}/codes")

    def vectors(self) -> DataFrame:
        return self.spark.read.schema("id long, same long, vec array<float>, slot int").parquet(f"{self.path}/vectors")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float32).reshape(len(column), dims)


def centroids_of(sample: np.ndarray, cells: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """Centroids of directions; a cell that nothing is nearest to starts anew at the row that is worst off."""
    rng = np.random.default_rng(seed)
    x = np.unique(_unit(sample.astype(np.float64)).astype(np.float32), axis=0)
    cells = min(cells, len(x))
    own = x[rng.permutation(len(x))[:cells]]
    for _ in range(rounds):
        score = x @ own.T
        nearest = score.argmax(1)
        sums = np.zeros_like(own)
        np.add.at(sums, nearest, x)
        worst = iter(np.argsort(score.max(1), kind="stable").tolist())
        for c in np.flatnonzero((np.linalg.norm(sums, axis=1) < 1e-6) | (np.bincount(nearest, minlength=cells) == 0)).tolist():
            sums[c] = x[next(worst)]
        own = _unit(sums)
    return own


def probes_for(sample: np.ndarray, centroids: np.ndarray, target: float, k: int = 10, queries: int = 256) -> int:
    """How many cells hold a share of ``target`` of the k nearest rows of a sample's own rows: one for data in clear clusters, most cells where there are none."""
    x = _unit(sample)
    own = x[:queries]
    score = own @ x.T
    score[np.arange(len(own)), np.arange(len(own))] = -np.inf
    near = np.argsort(-score, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(-(own @ centroids.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(place[np.arange(len(own))[:, None], (x @ centroids.T).argmax(1)[near]].ravel())
    return int(needed[ceil(target * len(needed)) - 1]) + 1 if len(needed) else 1


def build(df: DataFrame, vec: str, id_col: str, path: str, cells: int | None = None, sample: int = 16_384, slot_rows: int = 65_536, target: float = 0.97) -> VectorIndex:
    """Index all rows whose vector has a direction and the most common length of the sample; others can't be ranked.

    ``cells`` are as many as the square root of the number of rows, from 1 to 1,024, if not given.
    Centroids come from at most ``sample`` rows, those whose ids have the smallest hashes, and so does
    the number of cells to look at for a recall of about ``target``. Repeated and null ids are indexed
    like any.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec}`").cast("array<float>").alias("vec")).where(has_direction("vec"))
    n = rows.count()
    share = min(1.0, 4 * sample / max(1, n))
    few = rows if share == 1 else rows.where(F.xxhash64("id") < F.lit(int((2 * share - 1) * (1 << 63))))
    picked = [r.vec for r in few.orderBy(F.xxhash64("id"), "id", "vec").limit(sample).collect()]
    dims = max(sorted({len(v) for v in picked}), key=[len(v) for v in picked].count) if picked else 1
    own = [v for v in picked if len(v) == dims]
    cells = cells or min(1024, max(1, round(sqrt(n))))
    centroids = centroids_of(np.array(own, np.float32), cells) if own else np.ones((1, 1), np.float32)
    probes = probes_for(np.array(own, np.float32), centroids, target) if own else 1
    # Some 65,536 slots in all at most, so that listing them stays cheap; they grow beyond that.
    slots = max(1, min(ceil(n / len(centroids) / slot_rows), ceil(65_536 / len(centroids))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(_matrix(batch.column(1), dims))
            cell = (x @ centroids.T).argmax(1)
            rest = x - centroids[cell]
            scale = np.maximum(np.abs(rest).max(1), 1e-12) / 127
            code = np.rint(rest / scale[:, None]).astype(np.int8)
            error = np.linalg.norm(rest - code * scale[:, None], axis=1)
            codes = pa.array([c.tobytes() for c in code], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(cell, pa.int32()), codes, pa.array(scale, pa.float32()), pa.array(error, pa.float32())],
                names=["id", "vec", "same", "cell", "code", "scale", "error"],
            )

    coded = rows.where(F.size("vec") == dims).withColumn("same", F.xxhash64("vec")).mapInArrow(run, "id long, vec array<float>, same long, cell int, code binary, scale float, error float")
    coded = coded.withColumn("slot", F.col("cell") * slots + F.pmod(F.xxhash64("id", "same"), F.lit(slots)).cast("int"))
    coded.write.parquet(f"{path}/all")
    spark = df.sparkSession
    whole = spark.read.parquet(f"{path}/all")
    whole.drop("vec").hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/codes")
    whole.select("id", "same", "vec", "slot").distinct().hint("rebalance", "slot").write.partitionBy("slot").parquet(f"{path}/vectors")
    spark.createDataFrame([(i, slots, probes, c.tolist()) for i, c in enumerate(centroids)], "cell int, slots int, probes int, centroid array<float>").coalesce(1).write.parquet(f"{path}/centroids")
    gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/all")
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return VectorIndex(spark, path, centroids, slots, probes)


def load(spark: SparkSession, path: str) -> VectorIndex:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    return VectorIndex(spark, path, np.array([r.centroid for r in rows], np.float32), rows[0].slots, rows[0].probes)


def _best(found: dict[str, np.ndarray], k: int, keep: int | None) -> dict[str, np.ndarray]:
    """Of one query's rows those that bounds allow among the k best, or the ``keep`` best by estimate; of rows with one vector no more than the first k."""
    if len(found["id"]) <= k:
        return found
    order = np.lexsort((found["id"], found["same"]))
    same = found["same"][order]
    start = np.flatnonzero(np.concatenate(([True], same[1:] != same[:-1])))
    place = np.arange(len(same)) - np.repeat(start, np.diff(np.append(start, len(same))))
    order = order[place < k]
    lower, upper = (found["score"][order] + s * (found["error"][order] + SLACK) for s in (-1, 1))
    if keep is None:
        order = order[upper >= np.partition(lower, -k)[-k]] if len(order) > k else order
    else:
        order = order[np.argsort(-found["score"][order], kind="stable")[:keep]]
    return {name: column[order] for name, column in found.items()}


def _candidates(index: VectorIndex, names: list, m: np.ndarray, probed: np.ndarray, rows: DataFrame, k: int, keep: int | None) -> DataFrame:
    """(query, id, same, slot, score) of one block of queries, from the rows of their cells; each task keeps its own best for each query."""
    centroids, dims = index.centroids, index.centroids.shape[1]
    asks = {c: np.flatnonzero((probed == c).any(1)) for c in np.unique(probed).tolist()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, dict[str, np.ndarray]] = {}
        for batch in in_slices(batches, 1024):  # at most as many scores as these rows times the queries
            cell = np.asarray(batch.column(6))
            for c in np.unique(cell).tolist():
                at = np.flatnonzero(cell == c)
                own = batch.take(pa.array(at))
                code = np.frombuffer(b"".join(own.column(3).to_pylist()), np.int8).reshape(-1, dims)
                x = centroids[c] + code * np.asarray(own.column(4))[:, None]
                score = m[asks[c]] @ x.T
                about = {"id": np.asarray(own.column(0)), "same": np.asarray(own.column(1)), "slot": np.asarray(own.column(2)), "error": np.asarray(own.column(5))}
                for q, s in zip(asks[c].tolist(), score, strict=True):
                    new = about | {"score": s}
                    if q in best:
                        new = {name: np.concatenate((best[q][name], new[name])) for name in new}
                    best[q] = _best(new, k, keep)
        for q, found in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[q]] * len(found["id"]), pa.int64()), pa.array(found["id"], pa.int64()), pa.array(found["same"]), pa.array(found["slot"]), pa.array(found["score"], pa.float64())],
                names=["query", "id", "same", "slot", "estimate"],
            )

    own = rows.where(F.col("cell").isin([int(c) for c in asks])).select("id", "same", "slot", "code", "scale", "error", "cell")
    return own.mapInArrow(run, "query long, id long, same long, slot int, estimate double")


def search(
    index: VectorIndex, queries: DataFrame, query_vec: str, query_id: str, k: int, id_col: str = "id", probes: int | None = None, candidates: int | None = None,
    exact: bool = False, among: DataFrame | None = None, block: int = 1024,
) -> DataFrame:
    """(query_id, id_col, score, rank): the k nearest rows of every query, ids being whole numbers.

    ``probes`` cells are looked at for each query (the index's own number if not given), and the ``candidates`` best by estimate (10 k if
    not given) get exact scores. ``exact`` looks at all cells and keeps all that the bounds allow.
    ``among`` (column id_col) lets only these rows through, before they are ranked. Rows of equal
    score are ranked by id; queries without direction or of another length find nothing. Queries
    are taken in blocks of a bounded size; slots of candidates are all that is read of the vectors.
    """
    spark, dims = index.spark, index.centroids.shape[1]
    schema = f"`{query_id}` long, `{id_col}` long, score double, rank int"
    good = queries.select(F.col(f"`{query_id}`").cast("long").alias("query"), F.col(f"`{query_vec}`").alias("qv")).where(has_direction("qv") & (F.size("qv") == dims))
    keep = None if exact else candidates or 10 * k
    rows = index.codes().where("id is not null")
    if among is not None:
        rows = rows.join(among.select(F.col(f"`{id_col}`").cast("long").alias("id")).distinct(), "id", "left_semi")
    n = -(-good.count() // block)
    parts = []
    for b in range(n):
        own = good.where(F.pmod(F.xxhash64("query"), F.lit(n)) == b).collect()
        if not own:
            continue
        m = _unit(np.array([r.qv for r in own], np.float64)).astype(np.float32)
        score = m @ index.centroids.T
        probed = np.argsort(-score, axis=1, kind="stable")[:, : score.shape[1] if exact else probes or index.probes]
        parts.append(_candidates(index, [r.query for r in own], m, probed, rows, k, keep))
    if not parts:
        return spark.createDataFrame([], schema)
    found = reduce(DataFrame.union, parts)
    if keep is not None:
        best = Window.partitionBy("query").orderBy(F.desc("estimate"), "id")
        found = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= keep).drop("nth")
    exact_rows = found.join(index.vectors(), ["slot", "id", "same"]).join(good, "query")
    scored = exact_rows.select("query", F.col("id").alias(id_col), similarity(F.col("vec"), F.col("qv")).alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 12)), id_col)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumnRenamed("query", query_id)


def nearest(index: VectorIndex, query: list[float], k: int, id_col: str = "id", least: float = 0.0, num_candidates: int | None = None, probes: int | None = None, among: DataFrame | None = None) -> DataFrame:
    """(id_col, score) of the rows nearest to one vector, as ``vectors.knn`` gives it; twice k candidates if not told otherwise."""
    one = index.spark.createDataFrame([(0, [float(x) for x in query])], "query long, qv array<double>")
    found = search(index, one, "qv", "query", k, id_col, probes, num_candidates or 2 * k, among=among)
    return found.where(F.col("score") >= least).orderBy("rank").select(id_col, "score")


def recall(found: DataFrame, true: DataFrame, query_id: str, id_col: str) -> float:
    """The share of true (query, id) pairs that a search found."""
    pairs = true.select(query_id, id_col).distinct()
    n = pairs.count()
    return pairs.join(found.select(query_id, id_col), [query_id, id_col], "left_semi").count() / n if n else 1.0
