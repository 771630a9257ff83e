"""Quality classifier: a linear model on naive Bayes support vectors.

Features are indicators of hashed n-grams. Each is scaled by the log ratio of its smoothed counts in
good and bad training texts; on these vectors, of length one, a hinge-loss model is fitted by dual
coordinate descent, and a logistic curve, fitted on training rows that the model has not seen, turns
margins into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import in_slices, smallest_hashes, text_bytes
from codeloom.llm.ngrams import LOWER, mix, word_hashes
from codeloom.sources.scratch import discard, materialize
from codeloom.sources.tables import read_table

BITS = 18
CHUNK = 1 << 20
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123], SHAPE[128:], SHAPE[65:91], SHAPE[48:58] = 97, 97, 65, 48

_seen = np.zeros(1 << BITS, np.int64)


def _chunk_features(raw: np.ndarray) -> np.ndarray:
    words, _, _ = word_hashes(raw, LOWER)
    small = LOWER[raw].astype(np.uint64)
    shape = SHAPE[raw]
    shape = shape[np.concatenate(([True], shape[1:] != shape[:-1]))].astype(np.uint64)
    again = (words[1:] == words[:-1]).astype(np.uint64)
    u = np.uint64
    grams = [
        words,
        words[:-1] * u(3) + words[1:],
        small[:-3] | small[1:-2] << u(8) | small[2:-1] << u(16) | small[3:] << u(24),
        shape,
        shape[:-1] | shape[1:] << u(8),
        shape[:-2] | shape[1:-1] << u(8) | shape[2:] << u(16),
        again[:-2] | again[1:-1] << u(1) | again[2:] << u(2),
    ]
    return np.concatenate([mix(g + u(k << 56)) >> u(64 - BITS) for k, g in enumerate(grams, 1)]).astype(np.int64)


def features(text: bytes) -> np.ndarray:
    """The distinct hashed n-grams of a whole text: words, word pairs, 4 bytes, 1 to 3 shapes of characters, repeats of words.

    Texts over a megabyte are taken in pieces that overlap by 64 bytes.
    """
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    if len(raw) <= CHUNK:
        found = _chunk_features(raw)
    else:
        found = np.unique(np.concatenate([np.unique(_chunk_features(raw[i : i + CHUNK + 64])) for i in range(0, len(raw), CHUNK)]))
    # Of equal numbers the one that was written last stays.
    place = np.arange(len(found))
    _seen[found] = place
    return found[_seen[found] == place]


class Model:
    """Weights by feature, and the curve from margins to probabilities."""

    def __init__(self, ratio: np.ndarray, weight: np.ndarray, bias: float, slope: float, shift: float):
        self.value = (ratio * weight).astype(np.float32)
        self.square = (ratio * ratio).astype(np.float32)
        self.bias, self.slope, self.shift = bias, slope, shift

    def score(self, found: np.ndarray) -> float:
        norm = np.sqrt(self.square[found].sum(dtype=np.float64)) or 1.0
        return float(1 / (1 + np.exp(-(self.slope * (self.value[found].sum(dtype=np.float64) / norm + self.bias) + self.shift))))


def log_count_ratio(rows: list[np.ndarray], good: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    counts = np.full((2, 1 << BITS), smooth)
    for found, y in zip(rows, good, strict=True):
        counts[int(y), found] += 1
    counts /= counts.sum(1, keepdims=True)
    return np.log(counts[1] / counts[0])


def dual_descent(rows: list[np.ndarray], good: np.ndarray, ratio: np.ndarray, c: float = 1.0, rounds: int = 12, seed: int = 0):
    """Weights and bias of the hinge-loss model: one dual variable at a time, both classes of equal weight in all."""
    rng = np.random.default_rng(seed)
    y = np.where(good, 1.0, -1.0)
    values = [ratio[x] / (np.sqrt((ratio[x] ** 2).sum()) or 1.0) for x in rows]
    most = np.where(good, c * len(y) / (2 * max(1, good.sum())), c * len(y) / (2 * max(1, (~good).sum())))
    alpha, w, bias = np.zeros(len(y)), np.zeros(1 << BITS), 0.0
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            x, v = rows[i], values[i]
            slope = y[i] * (w[x] @ v + bias) - 1
            new = min(max(alpha[i] - slope / 2, 0.0), most[i])  # the vector's length and the bias input are one
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[x] += step * v
                bias += step
                alpha[i] = new
    return w, bias


def logistic_curve(margin: np.ndarray, good: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift by Newton's method, on targets drawn in from 0 and 1."""
    t = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        s = p * (1 - p) + 1e-9
        g = np.array([((p - t) * margin).sum() + 1e-3 * a, (p - t).sum()])
        h = np.array([[(s * margin**2).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], good: np.ndarray) -> Model | None:
    """None where the rows hold fewer than two of either class."""
    if min(good.sum(), (~good).sum()) < 2:
        return None
    held = np.zeros(len(good), bool)
    for y in (True, False):
        held[np.flatnonzero(good == y)[::4]] = True  # a quarter of each class draws the curve
    own = [x for x, h in zip(rows, held, strict=True) if not h]
    ratio = log_count_ratio(own, good[~held])
    w, bias = dual_descent(own, good[~held], ratio)
    seen = Model(ratio, w, bias, 1.0, 0.0)
    p = np.array([seen.score(x) for x, h in zip(rows, held, strict=True) if h])
    return Model(ratio, w, bias, *logistic_curve(np.log(p / (1 - p)), good[held]))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, max_bytes: int = 128 << 20, text: str = "text", doc_id: str = "doc_id") -> tuple[Model | None, float]:
    """Fit on at most ``max_rows`` labelled documents, those whose ids have the smallest hashes; also the share of good ones.

    ``labels`` has doc_id and quality; rows where either is null are left out, and of several labels
    the lowest counts. Of several documents with one id that one counts whose features come first as
    bytes, the same in every run. The features of the sample, four bytes each, are collected in the
    order of the ids' hashes for as long as they come to at most ``max_bytes``, so a sample of very
    long texts has fewer rows. The sample's bound makes its ids safe to broadcast.
    """
    chosen = (
        smallest_hashes(labels.where("doc_id is not null and quality is not null"), "doc_id", max_rows)
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            found = [features(t).astype(np.int32).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["doc_id", "quality", "found"])

    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_bytes(F.col(f"`{text}`")).alias("text"))
    found = own.join(F.broadcast(chosen.select(F.col("doc_id").cast("long"), "quality")), "doc_id").select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, found binary")
    one = materialize(found.groupBy("doc_id").agg(F.min(F.struct("quality", "found")).alias("least")).select("doc_id", "least.*"), "sample")
    sizes = one.select(F.xxhash64("doc_id").alias("h"), "doc_id", F.octet_length("found").alias("bytes")).collect()
    total, last = 0, None
    for r in sorted(sizes):
        if total + r.bytes > max_bytes:
            break
        total, last = total + r.bytes, r
    rows = []
    if last:
        upto = (F.xxhash64("doc_id") < last.h) | ((F.xxhash64("doc_id") == last.h) & (F.col("doc_id") <= last.doc_id))
        rows = sorted(one.where(upto).collect())
    discard(one)
    good = np.array([r.quality == 1 for r in rows], bool)
    return fit([np.frombuffer(r.found, np.int32) for r in rows], good), float(good.mean()) if len(good) else 0.5


def score(docs: DataFrame, model: Model | None, share: float = 0.5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score) for every row. Null texts count as empty and, without n-grams, get the score of the bias.

    Without a model every score is ``share``. Repeated rows give repeated results; an empty table
    gives no rows; other columns do not matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            out = [model.score(features(t)) if model else share for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_bytes(F.col(f"`{text}`"))).mapInArrow(run, "doc_id long, score double")


def op1_nb_svm(spark, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; the rows held out of training are marked."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held)
    model, share = train(docs, labels)
    return score(docs, model, share).select(
        "doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")
    )
