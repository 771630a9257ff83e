"""Sharding by histogram sort.

Rows have a 63-bit sort key: the CRC-32 of the text, then 31 bits of a hash of the id. Copies of
a text therefore lie side by side, and a group of copies larger than a shard still splits. Rows
that agree in the key, such as repeated ones, have a second key, a hash of their number in the
table, which is looked at only where a splitter would fall among them. The splitters between shards are found by counting: each pass takes exact bytes and rows of 2^k equal
parts of every key range that a splitter is known to lie in, and narrows the range, until the
bytes below the splitter are within the tolerance or the range holds one row. Then the rows are
exchanged once. Only the counts, a bounded number for each splitter, reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.sources.scratch import materialize
from codeloom.sources.tables import read_table

KEY_BITS = 63


@dataclass
class Splitter:
    """The key at which a shard or a piece of it begins, and what lies below."""

    key: int
    bytes_below: int
    rows_below: int
    tie: int = 0  # of the rows with just this key those whose second key is less are below too


def find_splitters(keys: DataFrame, targets: list[float], slack: list[float], probe_bits: int = 10) -> list[Splitter]:
    """Splitters whose bytes below come nearest to the targets.

    ``keys`` has columns key, tie and size; key and tie lie below 2^63. A splitter is done when the
    bytes below are within its slack of the target, or when its range holds one row; where it holds
    one key of several rows, the second key is searched in the same way.
    """
    done: list[Splitter | None] = [None] * len(targets)
    where = dict.fromkeys(range(len(targets)), (0, 0, 0))  # target -> prefix, bytes and rows below it
    tied: dict[int, list[int]] = {}  # a key of several rows -> the targets among them
    depth = 0
    first = max(probe_bits, ceil(log2(len(targets) + 1)) + 4)
    while where:
        last, depth = depth, min(KEY_BITS, depth + (probe_bits if depth else first))
        rows = keys if not last else keys.where(F.shiftright("key", KEY_BITS - last).isin(sorted({p for p, _, _ in where.values()})))
        counts = (
            rows.groupBy(F.shiftright("key", KEY_BITS - depth).alias("prefix"))
            .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
            .collect()
        )
        parts: dict[int, list] = {}
        for r in sorted(counts):
            parts.setdefault(r.prefix >> (depth - last), []).append(r)
        for t, (prefix, bytes_below, rows_below) in list(where.items()):
            for r in parts[prefix]:
                if bytes_below + r.bytes >= targets[t] or r is parts[prefix][-1]:
                    break
                bytes_below, rows_below = bytes_below + r.bytes, rows_below + r.rows
            low = Splitter(r.prefix << (KEY_BITS - depth), bytes_below, rows_below)
            high = Splitter((r.prefix + 1) << (KEY_BITS - depth), bytes_below + r.bytes, rows_below + r.rows)
            near = min(low, high, key=lambda s: abs(s.bytes_below - targets[t]))
            if abs(near.bytes_below - targets[t]) <= slack[t] or r.rows == 1:
                done[t] = near
                del where[t]
            elif depth == KEY_BITS:
                done[t] = low
                tied.setdefault(r.prefix, []).append(t)
                del where[t]
            else:
                where[t] = (r.prefix, bytes_below, rows_below)
    for key, own in tied.items():
        rows = keys.where(F.col("key") == key).select(F.col("tie").alias("key"), F.lit(0).alias("tie"), "size")
        inner = find_splitters(rows, [targets[t] - done[t].bytes_below for t in own], [slack[t] for t in own], probe_bits)
        for t, s in zip(own, inner, strict=True):
            done[t] = Splitter(key, done[t].bytes_below + s.bytes_below, done[t].rows_below + s.rows_below, s.key)
    return done


def _search(key: Column, tie: Column, bounds: list[Splitter], low: int = 0) -> Column:
    """How many of the sorted splitters are at or below the key: nested comparisons, as deep as the logarithm of their number."""
    if not bounds:
        return F.lit(low)
    m = len(bounds) // 2
    below = (key < bounds[m].key) | ((key == bounds[m].key) & (tie < bounds[m].tie)) if bounds[m].tie else key < bounds[m].key
    return F.when(below, _search(key, tie, bounds[:m], low)).otherwise(_search(key, tie, bounds[m + 1 :], low + m + 1))


def shard_by_bytes(
    df: DataFrame,
    n_shards: int = 40,
    text: str = "text",
    doc_id: str = "doc_id",
    overhead: int = 16,
    tolerance: float = 0.001,
    probe_bits: int = 10,
    piece_rows: int = 2_000_000,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add size, text_crc32, shard and slot (gapless from 0 in each shard) to every row.

    Sizes are UTF-8 bytes plus ``overhead``; a null text has no bytes and the checksum of an empty
    one. Shards' sizes differ by the tolerance (a share of the mean) or by what one row at the edge
    weighs. Each shard is numbered in pieces of about ``piece_rows`` rows, so that no task sorts a
    whole large shard. Rows with the same text and id stand together and split like any others;
    which of them goes where follows their order in the table. Null ids count like any id. An empty
    table gives no rows. ``keep`` names the columns to carry on (all by default); those that have one
    of the added names are replaced, and all others keep their values. The rows are written once to
    a scratch table, which all passes read.
    """
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    mask = F.lit((1 << 31) - 1)
    crc = F.crc32(content.cast("binary"))
    added = ("size", "text_crc32", "shard", "slot")
    carried = [c for c in (df.columns if keep is None else keep) if c not in added]
    rows = materialize(
        df.select(
            F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"),
            (F.octet_length(content) + F.lit(overhead)).cast("long").alias("size"),
            crc.alias("crc"),
            F.shiftleft(crc, 31).bitwiseOR(F.xxhash64(F.col(f"`{doc_id}`")).bitwiseAND(mask)).alias("key"),
            F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 1).alias("tie"),
        ),
        "keyed",
    )
    keys = rows.select("key", "tie", "size")
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    per_shard = max(1, ceil(total.rows / n_shards / piece_rows))
    n = n_shards * per_shard
    targets = [total.bytes * i / n for i in range(1, n)]
    slack = [total.bytes / n_shards * tolerance if i % per_shard == 0 else total.bytes / n / 4 for i in range(1, n)]
    found = find_splitters(keys, targets, slack, probe_bits) if total.rows else []
    # Numbers of pieces over all shards; a piece's shard and the rows before it there are looked up.
    piece = _search(F.col("key"), F.col("tie"), found)
    starts = [Splitter(0, 0, 0), *found]
    before = F.array(*[F.lit(s.rows_below - starts[i - i % per_shard].rows_below) for i, s in enumerate(starts)])
    dealt = rows.withColumn("piece", piece)
    order = Window.partitionBy("piece").orderBy("key", "tie")
    return dealt.select(
        *[F.col("row")[c].alias(c) for c in carried],
        "size",
        F.col("crc").alias("text_crc32"),
        F.floor(F.col("piece") / per_shard).cast("int").alias("shard"),
        (F.row_number().over(order).cast("long") - 1 + F.element_at(before, F.col("piece") + 1).cast("long")).alias("slot"),
    )


def op3_histogram_sort(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    docs = read_table(spark, sf_dir, "documents")
    return shard_by_bytes(docs, n_shards=40, keep=["doc_id"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
