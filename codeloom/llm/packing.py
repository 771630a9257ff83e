"""Best-fit packing into sequences of several permitted lengths.

Lengths are counted in tokens of a public vocabulary. Texts longer than the longest length are cut
into pieces, between tokens and between characters. Pieces are dealt into groups by a hash, so that
any group fits a task, and each group is packed from the longest piece left on: for every permitted
length that holds it, the bin is filled on trial with the pieces left that fit it best, and the
length is opened whose cost for each token so placed is the least. So a short length is opened where
what is left fills it, and a long one where only together pieces come to little waste. At the end
every bin shrinks to the shortest permitted length that holds its contents.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import deal, in_slices, partitions_for
from codeloom.llm.secrets import VOCABULARY, encoder
from codeloom.sources.tables import read_table

LENGTHS = (1024, 2048, 4096, 8192, 16384)
#: Runs of one kind of character longer than this are encoded in parts: a tokenizer takes long over them.
RUN = 512
_LONG_RUN = re.compile(rf"\S{{{RUN + 1},}}|\s{{{RUN + 1},}}")


def cost(length: int, fixed: int = 64, knee: int = 65536) -> float:
    """What a sequence of a length costs: its tokens, attention that grows with the square, and a fixed part."""
    return length + length * length / knee + fixed


class Pieces:
    """Pieces that are left, by size: how many there are of each, and which sizes there are."""

    def __init__(self, sizes: np.ndarray):
        self.sizes, counts = np.unique(sizes, return_counts=True)
        self.sizes, self.counts = self.sizes.tolist(), counts.tolist()
        self.below = list(range(-1, len(self.sizes)))  # for each place and one more: the next place below that may have pieces left

    def _left(self, at: int) -> int:
        """The last place below ``at`` with pieces left, or -1; what was found is kept for the next time."""
        path = []
        while (next_ := self.below[at]) >= 0 and not self.counts[next_]:
            path.append(at)
            at = next_
        for x in path:
            self.below[x] = next_
        return next_

    def largest(self) -> int:
        return self.sizes[at] if (at := self._left(len(self.sizes))) >= 0 else -1

    def fill(self, room: int) -> list[tuple[int, int]]:
        """(place, number): the largest pieces that fit, each time into the room that is still there."""
        out, at = [], len(self.sizes)
        while room > 0:
            at = self._left(min(at, bisect_right(self.sizes, room)))
            if at < 0:
                break
            n = min(self.counts[at], room // self.sizes[at])
            out.append((at, n))
            room -= n * self.sizes[at]
        return out

    def take(self, chosen: list[tuple[int, int]]) -> None:
        for at, n in chosen:
            self.counts[at] -= n


def pack(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each piece its bin, its bin's final length and its offset in the bin.

    No piece may be longer than the longest length. Of pieces of one size those that come first are
    placed first. Pieces of no length take no room; they are in the last bin. Of lengths whose cost
    for a token is the same the shortest is opened.
    """
    lengths = tuple(sorted(lengths))
    order = np.argsort(-sizes, kind="stable")
    some = order[sizes[order] > 0]
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    filled: list[int] = []
    if len(some):
        left = Pieces(sizes[some])
        ends = np.searchsorted(-sizes[some], -np.array(left.sizes), side="right")
        next_ = (ends - np.array(left.counts)).tolist()  # of each size the first piece not placed
        while (largest := left.largest()) > 0:
            trials = [(c, left.fill(c)) for c in lengths if c >= largest]
            per_token = lambda t: cost(t[0]) / sum(n * left.sizes[at] for at, n in t[1])
            _, chosen = min(trials, key=per_token)
            left.take(chosen)
            used = 0
            for at, n in chosen:
                own = some[next_[at] : next_[at] + n]
                next_[at] += n
                bins[own], offsets[own] = len(filled), used + np.arange(n) * left.sizes[at]
                used += n * left.sizes[at]
            filled.append(used)
    if len(some) < len(sizes):
        filled = filled or [0]
        empty = order[len(some) :]
        bins[empty], offsets[empty] = len(filled) - 1, filled[-1]
    final = np.array(lengths)[np.searchsorted(lengths, filled)] if filled else np.zeros(0, np.int64)
    return bins, final[bins] if len(bins) else final, offsets


def tokens_of(text: str, vocabulary: str = VOCABULARY) -> list[int]:
    """The tokens of a whole text; very long runs without a change between blanks and others are encoded in parts."""
    own = encoder(vocabulary)
    if len(text) <= RUN or not _LONG_RUN.search(text):
        return own.encode_ordinary(text)
    out, at = [], 0
    for m in _LONG_RUN.finditer(text):
        out += own.encode_ordinary(text[at : m.start()])
        for i in range(m.start(), m.end(), RUN):
            out += own.encode_ordinary(text[i : min(i + RUN, m.end())])
        at = m.end()
    return out + own.encode_ordinary(text[at:])


def pieces_of(text: str | None, longest: int, vocabulary: str = VOCABULARY) -> Iterator[tuple[int, int, str | None]]:
    """(first token, end, text) of a text's pieces of at most ``longest`` tokens; a cut is between two tokens that are no parts of one character.

    Where so many tokens in a row straddle characters, their characters are encoded by themselves;
    the tokens are then those of the pieces, one after another. A character may take 4 tokens, so
    ``longest`` is at least 4.
    """
    tokens = tokens_of(text, vocabulary) if text else []
    if len(tokens) <= longest:
        yield 0, len(tokens), text
        return
    raw = encoder(vocabulary).decode_tokens_bytes(tokens)
    inside = [t[0] & 0xC0 == 0x80 for t in raw] + [False]  # a character goes on here
    first = at = 0
    while first < len(tokens):
        end = min(first + longest, len(tokens))
        while inside[end] and end > first:
            end -= 1
        if end > first:
            yield at, at + end - first, b"".join(raw[first:end]).decode("utf-8", "surrogatepass")
            at += end - first
        else:
            end = inside.index(False, first + 1)
            part, n = "", 0
            for c in b"".join(raw[first:end]).decode("utf-8", "surrogatepass"):
                size = len(tokens_of(c, vocabulary))
                if n + size > longest:
                    yield at, at + n, part
                    at, part, n = at + n, "", 0
                part, n = part + c, n + size
            yield at, at + n, part
            at += n
        first = end


PIECE = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("grp", pa.int64())])


def pack_documents(
    df: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    lengths: tuple[int, ...] = LENGTHS,
    vocabulary: str = VOCABULARY,
    group_bytes: int = 32 << 20,
) -> DataFrame:
    """One row for each piece of a text: row_id, doc_id, piece, start and end (its tokens in the text), text, bin_id, bin_length, bin_offset.

    The pieces of a row, put together, are its text; ``row_id`` tells rows apart, also where their ids
    are null or the same. The longest length is at least 4, what a character may take. Null and empty texts take no room but have a
    row. Repeated rows are packed each for itself. Groups hold about ``group_bytes`` of text: their
    number grows with the input, and no bin spans two. Copies of a row and pieces of one text are
    dealt to different groups, so none grows with them. Other columns do not matter; an empty table
    gives no rows. Every executor must be able to read the vocabulary file.
    """
    longest = max(lengths)
    if longest < 4:
        raise ValueError("the longest length must hold any character, which may take 4 tokens")
    own = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    total = own.agg(F.coalesce(F.sum(F.octet_length("text").cast("long") + 8), F.lit(0))).first()[0]
    groups = max(1, ceil(total / group_bytes))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            rows = [
                (r, d, k, *piece, salt)
                for r, d, t, salt in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                for k, piece in enumerate(pieces_of(t, longest, vocabulary))
            ]
            columns = list(zip(*rows, strict=True)) or [[]] * len(PIECE)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECE, strict=True)], schema=PIECE)

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "piece", "end", "text", "row_id")])
        sizes = table["end"].to_numpy() - table["start"].to_numpy()
        bins, final, offsets = pack(sizes, lengths)
        added = {"bin_id": table["grp"].to_numpy().astype(np.int64) * (1 << 32) + bins, "bin_length": final, "bin_offset": offsets}
        return pa.table({c: table[c] for c in PIECE.names[:-1]} | {c: pa.array(x, pa.int64()) for c, x in added.items()})

    # A hot text, or id, is spread by the number of its row; which group a row is in does not matter otherwise.
    pieces = own.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text").withColumn("grp", F.xxhash64("doc_id", "row_id")).mapInArrow(cut, "row_id long, doc_id long, piece long, start long, end long, text string, grp long")
    tasks = partitions_for(total, min(groups, df.sparkSession.sparkContext.defaultParallelism))
    dealt = deal(pieces.withColumn("grp", F.pmod(F.xxhash64("grp", "piece"), F.lit(groups)).cast("int")), "grp", tasks)
    return dealt.groupBy("grp").applyInArrow(place, "row_id long, doc_id long, piece long, start long, end long, text string, bin_id long, bin_length long, bin_offset long")


def op6_variable_best_fit(spark, sf_dir: str) -> DataFrame:
    """Every document's pieces in bins of five permitted lengths, by tokens of a public vocabulary."""
    return pack_documents(read_table(spark, sf_dir, "documents"))
