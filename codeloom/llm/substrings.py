"""Substring dedup: words in long passages that an earlier document holds too are removed.

A passage is a window of 13 words. Every window is routed by its minimizer, the least hash of the
runs of five words in it: equal windows have equal minimizers, and neighbouring windows mostly share
one, so documents fall into segments of a few windows that go to the same shard. Minimizers that
only one document has need no index. For the others each shard builds a compressed FM-index over
the distinct segments sent to it and streams all documents' segments through it by backward search;
every window gets the smallest id among the documents that hold it. Hashes only route: segments
travel as the words themselves, so that what is found equal is equal. Documents send each distinct
segment once for each bucket of documents, so a passage that very many documents share is gathered
before it moves. Where very many segments share a minimizer in different surroundings, their windows
are routed by the hash of all their words instead, which still brings equal windows together.

Buckets and shards only group small rows: what a bucket sends to a shard is one row of compressed
arrays, and there are at most as many rows as segments. Exchanges have as many partitions as the
input's bytes ask for.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import deal, partitions_for, text_bytes
from codeloom.llm.fm_index import FMIndex
from codeloom.llm.ngrams import mix
from codeloom.sources.tables import read_table

WIDTH, GRAM, LONGEST_RUN = 13, 5, 64


class Lexicon(dict):
    """Numbers for words, by first appearance."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number

    def codes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self), np.uint64, len(self))


def runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimizer) of the runs of windows that share a minimizer, from the words' hashes; there are at least 13."""
    gram = words[: len(words) - GRAM + 1].copy()
    for k in range(1, GRAM):
        gram = gram * np.uint64(0x100000001B3) + words[k : len(words) - GRAM + 1 + k]
    least, have = mix(gram), 1
    while have < WIDTH - GRAM + 1:
        step = min(have, WIDTH - GRAM + 1 - have)
        least, have = np.minimum(least[:-step], least[step:]), have + step
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    size = np.diff(np.concatenate([first, [len(least)]]))
    if size.max() > LONGEST_RUN:
        parts = -(-size // LONGEST_RUN)
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, size = np.repeat(first, parts) + within * LONGEST_RUN, np.minimum(np.repeat(size, parts) - within * LONGEST_RUN, LONGEST_RUN)
    return first, size, least[first]


class Bucket:
    """The distinct documents of a bucket that have an id and a window, in the order of their ids: (id, text's digest, words as numbers, first windows, numbers of windows, minimizers)."""

    def __init__(self, docs: list[tuple[int | None, bytes]]):
        self.lexicon = Lexicon()
        coded = []
        for doc_id, text in sorted({x for x in docs if x[0] is not None}):
            words = text.split()
            if len(words) >= WIDTH:
                coded.append((doc_id, xxhash.xxh3_64_intdigest(text), self.lexicon.codes(words)))
        self.hashes = self.lexicon.hashes()
        self.docs = [(d, digest, codes, *runs(self.hashes[codes])) for d, digest, codes in coded]

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct minimizers in order, whether documents of different ids have each, and how many segments do."""
        keys = np.concatenate([d[5] for d in self.docs]) if self.docs else np.zeros(0, np.uint64)
        ids = np.concatenate([np.full(len(d[5]), d[0], np.int64) for d in self.docs]) if self.docs else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        keys, ids = keys[order], ids[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        if not len(at):
            return keys, np.zeros(0, bool), np.zeros(0, np.uint32)
        return keys[at], np.minimum.reduceat(ids, at) < np.maximum.reduceat(ids, at), np.diff(np.append(at, len(keys))).astype(np.uint32)

    def segments(self, keys: np.ndarray, hot: np.ndarray) -> Iterator[tuple[int, int, int, int, bytes]]:
        """(id, text's digest, place, key, words' numbers) of the segments whose minimizers are among ``keys``; where those are hot, of single windows, with a key of their own."""
        for d, digest, codes, first, size, key in self.docs:
            at = np.searchsorted(keys, key)
            at[at == len(keys)] = 0
            for r in np.flatnonzero(keys[at] == key).tolist() if len(keys) else []:
                a, n = int(first[r]), int(size[r])
                if not hot[at[r]]:
                    yield d, digest, a, int(key[r]), codes[a : a + n + WIDTH - 1].tobytes()
                    continue
                for start in range(a, a + n):
                    own = codes[start : start + WIDTH]
                    yield d, digest, start, xxhash.xxh3_64_intdigest(self.hashes[own].tobytes()), own.tobytes()


def _documents(table: pa.Table) -> list[tuple[int | None, bytes]]:
    return list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True))


def _pack(*parts: np.ndarray | bytes) -> bytes:
    """Arrays in one compressed cell, each after its size."""
    raw = [x if isinstance(x, bytes) else x.tobytes() for x in parts]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(len(x).to_bytes(8, "little") + x for x in raw))


def _unpack(cell: bytes, *kinds) -> list:
    raw, at, out = zstandard.ZstdDecompressor().decompress(cell), 0, []
    for kind in kinds:
        end = at + 8 + int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : end] if kind is bytes else np.frombuffer(raw[at + 8 : end], kind))
        at = end
    return out


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else schema.empty_table()


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


#: What a bucket and a shard tell each other, one row for each pair of them that has something to tell.
CELL = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("data", pa.binary())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.binary())])


def _by_shard(keys: np.ndarray, shards: int):
    """The shards that keys fall to, each with the places of its keys, in order."""
    to = ((keys >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], np.diff(to[order]) != 0])) if len(to) else np.zeros(0, np.int64)
    return [(int(to[p[0]]), p) for p in np.split(order, cut[1:]) if len(p)]


def ask(table: pa.Table, shards: int) -> pa.Table:
    """A bucket's minimizers, to the shards: what it needs to know is which of them other documents have too."""
    keys, several, segments = Bucket(_documents(table)).keys()
    bucket = table["bucket"][0].as_py()
    return _rows([(bucket, s, _pack(keys[p], several[p], segments[p])) for s, p in _by_shard(keys, shards)], CELL)


def answer(table: pa.Table, hot: int) -> pa.Table:
    """Which minimizers of a shard several documents have, and which have more than ``hot`` segments, back to each bucket."""
    asked = [_unpack(x, np.uint64, bool, np.uint32) for x in table["data"].to_pylist()]
    keys, several, segments = (np.concatenate(x) for x in zip(*asked, strict=True))
    _, place, times = np.unique(keys, return_inverse=True, return_counts=True)
    live = np.bincount(place, weights=several) + times > 1
    many = np.bincount(place, weights=segments) > hot
    cut = np.cumsum([len(k) for k, _, _ in asked])[:-1]
    answers = zip(table["bucket"].to_pylist(), table["shard"].to_pylist(), np.split(live[place], cut), np.split(many[place], cut), strict=True)
    return _rows([(b, s, _pack(np.packbits(x), np.packbits(y))) for b, s, x, y in answers], CELL)


def send(docs: pa.Table, answers: pa.Table, shards: int) -> pa.Table:
    """A bucket's distinct segments to the shards of their minimizers; and under a shard below 0, which no other bucket has, where its documents have which segment."""
    own = Bucket(_documents(docs))
    keys, _, _ = own.keys()
    by_shard = dict(zip(answers["shard"].to_pylist(), answers["data"].to_pylist(), strict=True))
    live, many = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    for s, p in _by_shard(keys, shards):
        a, b = _unpack(by_shard[s], np.uint8, np.uint8)
        live[p], many[p] = np.unpackbits(a, count=len(p)), np.unpackbits(b, count=len(p))
    segments: dict[bytes, int] = {}
    least, to, places = [], [], []
    for d, digest, a, key, content in own.segments(keys[live], many[live]):  # in the order of ids
        s = segments.setdefault(content, len(segments))
        if s == len(least):
            least.append(d)
            to.append(key)
        places.append((d, digest, a, s))
    if not places:
        return CELL.empty_table()
    bucket = docs["bucket"][0].as_py()
    contents, words = list(segments), list(own.lexicon)
    least = np.array(least, np.int64)
    rows, renumbered, n = [], np.zeros(len(contents), np.int64), 0
    for s, p in _by_shard(np.array(to, np.uint64), shards):
        renumbered[p] = np.arange(n, n + len(p))
        n += len(p)
        used, codes = np.unique(np.frombuffer(b"".join(contents[i] for i in p), np.int32), return_inverse=True)
        lengths = np.array([len(contents[i]) // 4 for i in p], np.uint32)
        rows.append((bucket, s, _pack(codes.astype(np.uint32), lengths, least[p], b"\n".join(words[i] for i in used.tolist()))))
    ids, digests, starts, number = zip(*places, strict=True)
    cells = _pack(np.array(ids, np.int64), np.array(digests, np.uint64), np.array(starts, np.uint32), renumbered[list(number)].astype(np.uint32))
    return _rows([*rows, (bucket, -1 - bucket, cells)], CELL)


def index(table: pa.Table) -> pa.Table:
    """A shard's answer to each bucket: for each window of its segments the least id of a document that holds it."""
    if table["shard"][0].as_py() < 0:  # what the bucket needs to read the answers goes along with them
        return table.select(CELL.names)
    lexicon = Lexicon()
    codes, lengths, ids = [], [], []
    for cell in table["data"].to_pylist():
        own, length, least, words = _unpack(cell, np.uint32, np.uint32, np.int64, bytes)
        codes.append(lexicon.codes(words.split(b"\n"))[own])
        lengths.append(length.astype(np.int64))
        ids.append(least)
    words, all_lengths, ids = np.concatenate(codes), np.concatenate(lengths), np.concatenate(ids)
    # Of equal segments from several buckets one is indexed, with their least id.
    ends = np.cumsum(all_lengths)
    seen: dict[bytes, int] = {}
    number = np.array([seen.setdefault(words[e - n : e].tobytes(), len(seen)) for e, n in zip(ends.tolist(), all_lengths.tolist(), strict=True)])
    least = np.full(len(seen), np.iinfo(np.int64).max)
    np.minimum.at(least, number, ids)
    built = FMIndex(np.frombuffer(b"".join(seen), np.int32), np.array([len(x) // 4 for x in seen]), least, WIDTH)
    found = built.stream(words, all_lengths)
    cut = np.cumsum([len(c) for c in codes])[:-1]
    rows = zip(table["bucket"].to_pylist(), table["shard"].to_pylist(), lengths, np.split(found, cut), strict=True)
    return _rows([(b, s, _pack(own.astype(np.uint32), least)) for b, s, own, least in rows], CELL)


def apply(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """A bucket's documents without the words that windows of earlier documents cover."""
    cover: dict[tuple[int, int], list[np.ndarray]] = {}
    cells = sorted(zip(answers["shard"].to_pylist(), answers["data"].to_pylist(), strict=True))
    if cells:
        ids, digests, starts, segment = _unpack(cells[0][1], np.int64, np.uint64, np.uint32, np.uint32)
        sent = [_unpack(data, np.uint32, np.int64) for _, data in cells[1:]]
        least = np.concatenate([x for _, x in sent])
        ends = np.cumsum(np.concatenate([x for x, _ in sent]).astype(np.int64))
        begins = np.concatenate([[0], ends[:-1]])
        for d, digest, start, k in zip(ids.tolist(), digests.tolist(), starts.tolist(), segment.tolist(), strict=True):
            bad = np.flatnonzero(least[begins[k] : ends[k] - WIDTH + 1] < d)
            if len(bad):
                cover.setdefault((d, digest), []).append(bad + start)
    out = []
    for doc_id, text in _documents(docs):
        words = text.split()
        removed = 0
        bad = cover.get((doc_id, xxhash.xxh3_64_intdigest(text))) if cover else None
        if bad:
            change = np.zeros(len(words) + 1, np.int64)
            at = np.concatenate(bad)
            np.add.at(change, at, 1)
            np.add.at(change, at + WIDTH, -1)
            kept = np.cumsum(change)[:-1] == 0
            removed = len(words) - int(kept.sum())
            words = [words[i] for i in np.flatnonzero(kept)]
        out.append((doc_id, len(words) + removed, removed, b" ".join(words)))
    return _rows(out, RESULT)


def remove_repeats(df: DataFrame, text: str = "text", doc_id: str = "doc_id", bucket_bytes: int = 8 << 20, shard_bytes: int = 12 << 20, hot: int = 20_000) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text as UTF-8) for every row.

    A word goes if a window of 13 words over it also starts in a document with a smaller id; all
    windows are judged on the input. Null and empty texts have no words. Rows without an id keep all
    words and take none from others. Rows that share an id are one document for the comparison, and
    each gives a row. An empty table gives no rows. Other columns do not matter. The numbers of
    buckets and shards grow with the bytes of the input; minimizers with more than ``hot`` segments
    are spread over the shards.
    """
    source = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_bytes(F.col(f"`{text}`")).alias("text"))
    total = source.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    buckets, shards = max(1, ceil(total / bucket_bytes)), max(1, ceil(total / shard_bytes))
    tasks = partitions_for(total, df.sparkSession.sparkContext.defaultParallelism)
    docs = deal(source.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int")), "bucket", tasks)
    ddl = _ddl(CELL)
    asked = deal(docs.groupBy("bucket").applyInArrow(lambda t: ask(t, shards), ddl), "shard", tasks)
    live = deal(asked.groupBy("shard").applyInArrow(lambda t: answer(t, hot), ddl), "bucket", tasks)
    sent = deal(docs.groupBy("bucket").cogroup(live.groupBy("bucket")).applyInArrow(lambda a, b: send(a, b, shards), ddl), "shard", tasks)
    back = deal(sent.groupBy("shard").applyInArrow(index, ddl), "bucket", tasks)
    return docs.groupBy("bucket").cogroup(back.groupBy("bucket")).applyInArrow(apply, _ddl(RESULT))


def op8_fm_index(spark, sf_dir: str) -> DataFrame:
    """How much of every document repeats passages of earlier ones, and the digest of what stays."""
    docs = read_table(spark, sf_dir, "documents")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
