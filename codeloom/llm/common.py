"""What the operators share: words, Arrow batches, numbers of partitions, joins on hot keys, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.sources.scratch import discard, materialize

#: Words are runs of other characters than these; bytes.split() splits at exactly these.
WHITE_SPACE = b" \t\n\x0b\x0c\r"


def in_slices(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of fewer rows, as rows with whole texts are large; Spark itself bounds a batch's bytes."""
    for batch in batches:
        for first in range(0, len(batch), rows):
            yield batch.slice(first, rows)


def partitions_for(size: int, least: int = 1, fine: int = 16 << 20, coarse: int = 256 << 20) -> int:
    """Tasks for so many bytes: of 16 MB each up to 4,096 of them, and beyond that as many as have 256 MB each."""
    return max(least, min(4096, ceil(size / fine)), ceil(size / coarse))


def deal(df: DataFrame, number: str, parts: int) -> DataFrame:
    """Exchange rows so that the groups numbered 0, 1, 2 ... take turns over the partitions: each gets as many as any other, which hashing the numbers would not give it. The column is an int."""
    return df.repartitionById(parts, F.col(number))


def smallest_hashes(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows whose keys' hashes lie so low that about four times ``n`` do: a sample of ``n`` can be taken from these.

    Few rows of any partition are left, so the sample's sort sends little to the driver however
    many partitions there are.
    """
    share = min(1.0, 4 * n / max(1, df.count()))
    return df if share == 1 else df.where(F.xxhash64(key) < F.lit(int((2 * share - 1) * (1 << 63))))


def text_bytes(column) -> "F.Column":
    """A text as UTF-8 bytes; null counts as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit("")).cast("binary")


def spread_join(left: DataFrame, right: DataFrame, key: str, rows: int, parts: int = 1000) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has each key once and in column n how many rows of ``left`` have it.

    Keys with more than a ``parts``-th of all ``rows`` would each be one task's work. There are
    fewer than ``parts`` of them whatever the input, so they are broadcast, and only the others are
    exchanged. Column n goes.
    """
    hot = right.where(F.col("n") > rows / parts).drop("n")
    cold = right.where(F.col("n") <= rows / parts).drop("n")
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return left.join(F.broadcast(hot), key).unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph, as (node, label).

    ``edges`` has two long columns a and b. Each round every node moves to the neighbour whose
    salted hash is the least (or stays), edges are relabelled and deduplicated, and the graph
    shrinks by a constant factor on average, whatever the order of the ids. Only neighbours'
    minima are aggregated, so that a node with very many edges is combined before the shuffle, and
    nodes with very many edges are relabelled by a broadcast of bounded size. Each round's moves stay
    as a table; labels come from the last round back to the first, so that no table of all nodes is
    written again in every round. Isolated nodes do not appear. The label is a node of the component.
    """
    edges = materialize(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    moves = []
    turn = 0
    while n_edges := edges.count():
        rank = lambda c: F.xxhash64(F.lit(turn), F.col(c))  # noqa: B023, E731
        ends = edges.select("a", "b", F.lit(1).alias("first")).union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0).alias("first")))
        best = ends.groupBy("a").agg(
            F.min(F.struct(rank("b").alias("h"), F.col("b"))).alias("m"), F.sum("first").alias("as_a"), F.sum(1 - F.col("first")).alias("as_b")
        )
        moved = materialize(
            best.select("a", F.when(F.col("m.h") < rank("a"), F.col("m.b")).otherwise(F.col("a")).alias("p"), "as_a", "as_b"), f"moved{turn}"
        )
        left = moved.where("as_a > 0").select("a", F.col("p").alias("pa"), F.col("as_a").alias("n"))
        right = moved.where("as_b > 0").select(F.col("a").alias("b"), F.col("p").alias("pb"), F.col("as_b").alias("n"))
        old = edges
        edges = materialize(
            spread_join(spread_join(edges, left, "a", n_edges), right, "b", n_edges)
            .where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct(),
            f"edges{turn}",
        )
        discard(old)
        moves.append(moved)
        turn += 1
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels, read = moves[-1].select(F.col("a").alias("node"), F.col("p").alias("label")), moves[-1]
    for k in range(len(moves) - 2, -1, -1):
        own = moves[k].select(F.col("a").alias("node"), "p")
        ends = own.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
        to = ends.join(labels.select(F.col("node").alias("p"), "label"), "p", "left").select("p", "n", F.coalesce("label", "p").alias("label"))
        labels = materialize(spread_join(own, to, "p", own.count()).select("node", "label"), f"labels{k}")
        discard(moves[k], read)
        read = labels
    return labels
