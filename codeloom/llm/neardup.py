"""Near-duplicates by SimHash, found with Golay-code fuzzy hashing.

Fingerprints of 64 bits link at ``bits`` (4) or fewer differing bits. They are cut into four segments of
16 bits. The perfect binary Golay code has a codeword within 3 bits of any 23-bit word, so a
segment decodes to the indices of the codewords near it; segments that differ in one bit are sure
to share an index. Up to four errors over four segments leave one of these cases, each with keys
of its own:

* two segments or more without an error: six keys, for every pair of segments as they are;
* one without an error and at most one with two: for every segment as it is, the indices of two
  of the others, one of which has at most one error;
* one error in each: all combinations of the indices of the first three.

Equal keys bring fingerprints together in a bucket, where they are compared bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import components, deal, partitions_for, spread_join, text_bytes
from codeloom.sources.scratch import materialize
from codeloom.sources.tables import read_table

#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, which generates the code.
GENERATOR = 0b101011100011


def simhash(text: bytes, width: int = 4) -> int:
    """The fingerprint of a text: lower-case A-Z, shingles of ``width`` words, a bit set where over half the hashes have it.

    With fewer words the whole sequence is the only shingle; without any the fingerprint is zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, 42)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(line[a:b], 42) for a, b in zip((ends - sizes)[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64
    )
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 255):  # sums that fit a byte
        part = hashes[i : i + 255]
        set_bits += np.add.reduce(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column) -> Column:
    """The 64 bits of a text's fingerprint as a signed long."""
    return F.pandas_udf(lambda s: pd.Series(np.array([simhash(t) for t in s], np.uint64).view(np.int64)), "long")(text_bytes(text))


@lru_cache(maxsize=1)
def golay_keys() -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices for every 16-bit segment: where its indices start, and all of them in a row.

    The parity of a segment decides how far it looks: even ones take the codewords within 3 bits,
    odd ones those within 4. Segments one bit apart have different parity, so they share one.
    """

    def syndrome(words: np.ndarray) -> np.ndarray:
        for bit in range(22, 10, -1):
            words = np.where(words >> bit & 1, words ^ (GENERATOR << (bit - 11)), words)
        return words

    near = np.array([sum(1 << b for b in at) for k in range(5) for at in combinations(range(23), k)])
    size = np.bitwise_count(near)
    rest = syndrome(near)
    order = np.argsort(rest, kind="stable")
    near, size, starts = near[order], size[order], np.searchsorted(rest[order], np.arange(2049))
    own = syndrome(np.arange(1 << 16))
    all_keys = []
    for v in range(1 << 16):
        group = slice(starts[own[v]], starts[own[v] + 1])
        errors = near[group] if v.bit_count() & 1 else near[group][size[group] <= 3]
        all_keys.append(((v ^ errors) >> 11).astype(np.uint16))
    return np.concatenate([[0], np.cumsum([len(k) for k in all_keys])]), np.concatenate(all_keys)


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of fingerprints (uint64), and the place of the fingerprint that each belongs to."""
    starts, flat = golay_keys()
    seg = [(fps >> np.uint64(16 * i) & np.uint64(0xFFFF)).astype(np.int64) for i in range(4)]
    here = np.arange(len(fps))
    keys, owners = [], []

    def spread(tag: int, base: np.ndarray, owner: np.ndarray, by: list[np.ndarray]) -> None:
        for s in by:
            v = s[owner]
            n = starts[v + 1] - starts[v]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            base, owner = np.repeat(base, n) << 12 | flat[np.repeat(starts[v], n) + within], np.repeat(owner, n)
        keys.append(base | tag << 48)
        owners.append(owner)

    tag = 0
    for i in range(4):
        for j in range(i + 1, 4):
            spread(tag := tag + 1, seg[i] << 16 | seg[j], here, [])
        for j in [x for x in range(4) if x != i][:2]:
            spread(tag := tag + 1, seg[i], here, [seg[j]])
    spread(tag + 1, np.zeros(len(fps), np.int64), here, seg[:3])
    return np.concatenate(keys), np.concatenate(owners)


def spanning_links(fps: np.ndarray, bits: int, direct: int = 2000) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected among the fingerprints of one bucket.

    The search goes on from one fingerprint to those not yet reached, so a tight group takes one
    comparison a member and not one a pair. A bucket of over ``direct`` is split before: the bits in
    which its members differ are cut into one part more than there may be errors, so fingerprints
    that link agree in a part and meet among those that share it. What shares a part is split again
    in the bits that are left, for as long as it is large.
    """
    out, rest = [], np.unique(fps)
    if len(rest) <= direct:
        return _reached(rest, bits)
    differ = int(np.bitwise_or.reduce(rest ^ rest[0]))
    places = [i for i in range(64) if differ >> i & 1]
    if len(places) <= bits:
        return _reached(rest, bits)
    for k in range(bits + 1):
        shared = rest & np.uint64(sum(1 << i for i in places[k :: bits + 1]))
        order = np.argsort(shared, kind="stable")
        for group in np.split(rest[order], np.flatnonzero(np.diff(shared[order])) + 1):
            if len(group) > 1:
                out += spanning_links(group, bits, direct)
    return out


def _reached(rest: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    while len(rest) > 1:
        open_, rest = [rest[0]], rest[1:]
        while open_ and len(rest):
            at = open_.pop()
            near = np.bitwise_count(rest ^ at) <= bits
            if near.any():
                hit, rest = rest[near], rest[~near]
                out.append((np.full(len(hit), at), hit))
                open_.extend(hit)
    return out


def links(fps: DataFrame, bits: int = 4, keys_in_task: int = 1_000_000) -> DataFrame:
    """Links (a, b) between distinct fingerprints in column fp, enough to connect every component.

    Batches send their keys to tasks as arrays, one for each task that a key can go to; the number
    of tasks, and that of the partitions in which they are exchanged, grows with the number of
    fingerprints. A bucket keeps 8 bytes for each of its distinct fingerprints, and copies of a text
    have one fingerprint however many they are.
    """
    if bits > 4:
        raise ValueError("the keys cover up to 4 differing bits")
    keys = fps.count() * 70
    partitions = partitions_for(16 * keys, fps.sparkSession.sparkContext.defaultParallelism)
    tasks = partitions * max(1, ceil(keys / keys_in_task / partitions))  # as many for each partition

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(own), 20_000):
                keys, owner = bucket_keys(own[i : i + 20_000])
                to = (keys * -7046029254386353131 >> 33) % tasks
                order = np.argsort(to, kind="stable")
                keys, at = keys[order], own[i : i + 20_000][owner[order]]
                used, start = np.unique(to[order], return_index=True)
                rows = [(t, keys[a:b].tobytes(), at[a:b].tobytes()) for t, a, b in zip(used.tolist(), start.tolist(), [*start[1:].tolist(), len(keys)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["task", "keys", "fps"])

    def meet(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x, np.int64) for x in table["keys"].to_pylist()])
        own = np.concatenate([np.frombuffer(x, np.uint64) for x in table["fps"].to_pylist()])
        order = np.argsort(keys, kind="stable")
        keys, own = keys[order], own[order]
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.concatenate([start, [len(keys)]]))
        two = start[size == 2]
        two = two[np.bitwise_count(own[two] ^ own[two + 1]) <= bits]
        found = [(own[two], own[two + 1])]
        for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            found += spanning_links(own[s : s + n], bits)
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), np.uint64)
        return pa.table({"a": pairs[0].view(np.int64), "b": pairs[1].view(np.int64)})

    sent = fps.select("fp").mapInArrow(send, "task int, keys binary, fps binary")
    return deal(sent, "task", partitions).groupBy("task").applyInArrow(meet, "a long, b long")


def _labelled(by_fp: DataFrame, bits: int) -> DataFrame:
    """``by_fp``, which has distinct fingerprints, with the label of each one's component."""
    labels = components(links(by_fp, bits))
    return materialize(
        by_fp.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp")), "labelled"
    )


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", bits: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row: the smallest id that links reach, its own included.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows give repeated
    results. Null ids are reported but never name a component while it has another id. An empty
    table gives no rows. Fingerprints of very many rows and components of very many fingerprints
    are joined by a broadcast of bounded size.
    """
    docs = materialize(df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), fingerprint(F.col(f"`{text}`")).alias("fp")), "fingerprints")
    by_fp = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows")), "distinct")
    labelled = _labelled(by_fp, bits)
    firsts = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    of_fp = spread_join(labelled, firsts, "label", labelled.count()).select("fp", "component_id", F.col("rows").alias("n"))
    out = spread_join(docs, materialize(of_fp, "components"), "fp", docs.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, text: str = "text", doc_id: str = "doc_id", bits: int = 4) -> DataFrame:
    """Of each component of near-duplicates one row, with all its columns: that with the smallest id, and of rows with that id the one whose text has the least hash.

    What is decided is decided about rows, so two texts under one id may part ways. Ids that are null
    come last: such a row stays only where its component has no other. Of rows with the same id and
    text one stays, of those the one whose other columns have the least hash. Null and empty texts
    are near-duplicates of each other. An empty table gives no rows. Columns may have any names.
    """
    plain = [c for c, kind in df.dtypes if "map<" not in kind and kind != "variant"]
    others = [c for c in df.columns if c not in plain]  # these have no hash, so their JSON is hashed
    key = F.col(f"`{doc_id}`").cast("long")
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), key.isNull().alias("no_id"), F.coalesce(key, F.lit(0)).alias("id"), text_bytes(F.col(f"`{text}`")).alias("text")
    ).withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
    name = ["no_id", "id", "h1", "h2"]
    docs = rows.select(fingerprint(F.col("text")).alias("fp"), F.struct(*name).alias("name")).groupBy("fp").agg(F.min("name").alias("first"))
    winners = _labelled(materialize(docs, "distinct"), bits).groupBy("label").agg(F.min("first").alias("first")).select("first.*")
    # Rows that agree in id and text are one before anything moves, however many they are; texts move once, as the join has the same keys.
    single = rows.groupBy(*name).agg(F.min_by("row", F.xxhash64(*[F.col("row")[c] for c in plain], F.to_json(F.struct(*[F.col("row")[c].alias(c) for c in others])) if others else F.lit(0))).alias("row"))
    return single.join(winners, name, "left_semi").select("row.*")


def op4_golay_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the component of near-duplicates it is in."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))
