"""Benchmark decontamination by latent semantic retrieval.

The terms are the words of the benchmark items. Counts over all documents give them weights; a
randomised singular value decomposition of the weighted passages, whose sketches are summed over
the cluster, gives a space of few dimensions. Passages of all documents, and their halves, are
compared there by cosine with the items and with overlapping pieces of them, so that a part of an
item is not lost in the whole. Runs of words that a text shares with an item are looked up exactly,
whatever the cosine. Pairs that are near or share a run are checked on the words themselves: by the
longest common subsequence, and by whether the item's answer, its last sentence, occurs too.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import WHITE_SPACE, in_slices, text_bytes
from codeloom.llm.ngrams import IS_SPACE, in_groups, word_hashes, words_of
from codeloom.sources.tables import read_table

#: Words are compared in lower case and without ASCII punctuation.
PLAIN = bytes.maketrans(string.ascii_uppercase.encode() + string.punctuation.encode(), string.ascii_lowercase.encode() + b" " * len(string.punctuation))
HALF = 24  # words; passages are two halves, and every half but the outer ones is in two passages
SLICE = 512  # terms whose sums travel together
LONG_TEXT = 4 << 20  # bytes from which a text is searched in parts
PART = 400_000  # words in a part
LEADING = 18  # bits by which terms are looked up


def hashes(text: bytes) -> np.ndarray:
    return word_hashes(np.frombuffer(text.translate(PLAIN), np.uint8))[0]


def run_hashes(words: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    for k in range(width):
        out = out * np.uint64(0x100000001B3) + words[starts + k]
    return out


@dataclass
class Items:
    """A block of benchmark items: ids, their words as hashes, their answers, and the distinct terms in order."""

    ids: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    terms: np.ndarray
    sizes: np.ndarray
    buckets: np.ndarray  # how many terms lie below each run of leading bits
    in_item: np.ndarray  # the pairs of item and term that occur, for items of up to 64 words, as one number, in order
    at: np.ndarray  # where in the item the term stands, as bits

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Items | None:
        """Items without an id or a word are left out."""
        ids, words, answers = [], [], []
        for item, text in rows:
            raw = (text or "").encode("utf-8", "surrogatepass")
            if item is None or not len(h := hashes(raw)):
                continue
            sentences = [x for x in re.split(rb"[.?!:\n]+", raw.strip(WHITE_SPACE)) if len(hashes(x))]
            ids.append(item)
            words.append(h)
            answers.append(hashes(sentences[-1]) if sentences else h)
        if not ids:
            return None
        terms = np.unique(np.concatenate(words))
        below = np.cumsum(np.bincount((terms >> np.uint64(64 - LEADING)).astype(np.int64) + 1, minlength=(1 << LEADING) + 1))
        sizes = np.array(list(map(len, words)))
        short = [k for k, n in enumerate(sizes.tolist()) if n <= 64]
        pair = np.concatenate([k * len(terms) + np.searchsorted(terms, words[k]) for k in short] or [np.zeros(0, np.int64)])
        bit = np.uint64(1) << np.concatenate([np.arange(sizes[k], dtype=np.uint64) for k in short] or [np.zeros(0, np.uint64)])
        in_item, place = np.unique(pair, return_inverse=True)
        at = np.zeros(len(in_item), np.uint64)
        np.bitwise_or.at(at, place, bit)
        return cls(ids, words, answers, terms, sizes, below.astype(np.int32), in_item, at)

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, term) of the words that are terms."""
        lead = (words >> np.uint64(64 - LEADING)).astype(np.int64)
        first = self.buckets[lead]
        place = np.flatnonzero(self.buckets[lead + 1] > first)  # most words share no leading bits with a term
        words, at = words[place], first[place]
        same = self.terms[at] == words
        late = np.flatnonzero(~same)  # nor do many terms with each other
        at[late] = np.minimum(np.searchsorted(self.terms, words[late]), len(self.terms) - 1)
        same[late] = self.terms[at[late]] == words[late]
        return place[same], at[same].astype(np.int64)

    def pieces(self) -> tuple[list[np.ndarray], np.ndarray]:
        """The words of all items and of the pieces, half as long as a passage and overlapping by half, that longer ones are cut into; and whose they are."""
        out, of = [], []
        for k, words in enumerate(self.words):
            n = len(words)
            starts = [*range(0, n - HALF, HALF // 2), n - HALF] if n > HALF else []
            out += [words, *(words[a : a + HALF] for a in starts)]
            of += [k] * (1 + len(starts))
        return out, np.array(of)

    def in_order(self, item: np.ndarray, terms: np.ndarray, low: np.ndarray, high: np.ndarray, at_once: int = 20_000) -> np.ndarray:
        """For every pair of an item of up to 64 words and a region of ``terms``, of a text's words those that are any: how many words they have in common in order.

        The table of each pair is kept in the bits of one number, and all pairs go on by one word at a time.
        """
        out = np.zeros(len(item), np.int64)
        order = np.argsort(low - high, kind="stable")  # the longest regions first
        for part in (order[i : i + at_once] for i in range(0, len(order), at_once)):
            key, place, end = item[part] * len(self.terms), low[part], high[part]
            full = ~np.uint64(0) >> (64 - self.sizes[item[part]]).astype(np.uint64)
            row = full.copy()
            for step in range(int((end - place).max(initial=0))):
                here = np.flatnonzero(place + step < end)
                want = key[here] + terms[place[here] + step]
                found = np.minimum(np.searchsorted(self.in_item, want), len(self.in_item) - 1)
                same = self.in_item[found] == want
                here, mask = here[same], self.at[found[same]]
                hit = row[here] & mask
                row[here] = (row[here] + hit) | (row[here] - hit)
            out[part] = self.sizes[item[part]] - np.bitwise_count(row & full)
        return out

    def runs(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, item) of the distinct runs of ``width`` words in items, by hash."""
        pairs = [(run_hashes(w, np.arange(len(w) - width + 1), width), k) for k, w in enumerate(self.words) if len(w) >= width]
        if not pairs:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        run, item = np.concatenate([h for h, _ in pairs]), np.repeat([k for _, k in pairs], [len(h) for h, _ in pairs])
        order = np.lexsort((item, run))
        run, item = run[order], item[order]
        new = np.concatenate([[True], (run[1:] != run[:-1]) | (item[1:] != item[:-1])])
        return run[new], item[new]


class Halves:
    """The terms in the half passages of several texts; every text has one slot more, which stays empty, so that passages do not cross texts."""

    def __init__(self, texts: list[bytes], items: Items, weight: np.ndarray | None = None):
        self.words, self.first, self.n_words = words_of([t.translate(PLAIN) for t in texts])
        place, self.term = items.find(self.words)
        self.place, self.all_terms = place, self.term  # also of those that weigh nothing
        if weight is not None:
            own = weight[self.term] > 0
            place, self.term = place[own], self.term[own]
        slots = -(-self.n_words // HALF) + 1
        self.slot = np.cumsum(slots) - slots
        self.n_slots = int(slots.sum())
        text = np.repeat(np.arange(len(texts)), self.n_words)[place]
        self.half = self.slot[text] + (place - self.first[text]) // HALF
        self.n_halves = int((slots - 1).sum())

    def passages(self) -> np.ndarray:
        """Their first halves: those with a term in either half. The last half of a longer text is in the passage before it."""
        alone = np.zeros(self.n_slots + 1, bool)
        ends = np.append(self.slot[1:], self.n_slots)
        alone[ends - 1] = True
        alone[(ends - 2)[ends - self.slot > 2]] = True
        at = np.unique(np.concatenate([self.half, self.half - 1]))
        at = at[at >= 0]
        return at[~alone[at]]

    def in_runs(self, runs: tuple[np.ndarray, np.ndarray], width: int) -> np.ndarray:
        """Distinct rows of (half, item) where a run of ``width`` words that an item has begins."""
        none = np.zeros((0, 2), np.int64)
        if len(self.place) < width or not len(runs[0]):
            return none
        start = self.place[: len(self.place) - width + 1]
        start = start[self.place[width - 1 :] - start == width - 1]  # nothing but terms
        text = np.searchsorted(self.first, start, side="right") - 1
        within = start + width <= self.first[text] + self.n_words[text]
        start, text = start[within], text[within]
        run = run_hashes(self.words, start, width)
        low, high = np.searchsorted(runs[0], run), np.searchsorted(runs[0], run, side="right")
        hit = np.flatnonzero(high > low)
        if not len(hit):
            return none
        count = (high - low)[hit]
        item = runs[1][np.repeat(low[hit] - np.cumsum(count) + count, count) + np.arange(count.sum())]
        half = (self.slot[text] + (start - self.first[text]) // HALF)[hit]
        return np.unique(np.column_stack([np.repeat(half, count), item]), axis=0)

    def sums(self, table: np.ndarray) -> np.ndarray:
        """Of the rows of a table of terms, by slot; and one empty slot more. A half has few terms: all first ones are added, then all second ones, and so on."""
        out = np.zeros((self.n_slots + 1, *table.shape[1:]), table.dtype)
        if len(self.half):
            first = np.flatnonzero(np.concatenate([[True], np.diff(self.half) != 0]))
            count = np.diff(np.append(first, len(self.half)))
            for j in range(int(count.max())):
                at = first[count > j] + j
                out[self.half[at]] += table[self.term[at]]
        return out


def parts_of(text: bytes, words: int, overlap: int = 0) -> Iterator[bytes]:
    """A long text in parts of ``words`` words and ``overlap`` more, which the next part begins with."""
    text = text.translate(PLAIN)
    space = np.concatenate([[True], IS_SPACE[np.frombuffer(text, np.uint8)], [True]])
    starts = np.flatnonzero(space[:-1] & ~space[1:])
    ends = np.flatnonzero(~space[:-1] & space[1:])
    for i in range(0, max(1, len(starts) - overlap), words):
        own = slice(int(starts[i]), int(ends[min(i + words + overlap, len(ends)) - 1])) if len(starts) else slice(0, 0)
        yield text[own]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """Texts for counts and sums; long ones come in parts, as memory goes with the words at hand."""
    for batch in in_slices(batches):
        for _, texts in in_groups(batch.column(0).to_pylist()):
            if len(texts[0]) > LONG_TEXT:
                yield from ([part] for part in parts_of(texts[0], PART))
            else:
                yield texts


def halves_with(docs: DataFrame, items: Items) -> tuple[int, np.ndarray]:
    """The number of half passages in all documents, and of those that hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held = 0, np.zeros(len(items.terms), np.int64)
        for texts in _groups(batches):
            own = Halves(texts, items)
            n += own.n_halves
            pairs = np.sort(own.half * len(held) + own.term)
            held += np.bincount(pairs[np.diff(pairs, prepend=-1) != 0] % len(held), minlength=len(held))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int64()), pa.array(np.append(held[some], n), pa.int64())], names=["term", "n"])

    rows = docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    held, n = np.zeros(len(items.terms), np.int64), 0
    for r in rows:
        if r.term < 0:
            n = r.n
        else:
            held[r.term] = r.n
    return n, held


def term_weights(items: Items, n: int, held: np.ndarray, common: float = 0.05, least: int = 3) -> np.ndarray:
    """Inverse document frequencies; terms in over ``common`` of all halves weigh nothing, except those of items with fewer than ``least`` others."""
    weight = np.log((n + 1) / (held + 1)) + 1
    light = held > common * n
    for words in items.words:
        own = np.unique(np.searchsorted(items.terms, words))
        if (~light[own]).sum() < min(least, len(own)):
            light[own] = False
    return np.where(light, 0.0, weight)


def latent_space(docs: DataFrame, items: Items, weight: np.ndarray, rank: int = 192, more: int = 32) -> np.ndarray:
    """A basis (term, dimension) of the leading singular vectors of all passages, each scaled by its weights.

    A random test matrix is multiplied with the passages and back in one pass; every task sends
    one sum for each slice of terms. The singular values come from the sketch itself, and every
    dimension is divided by its own: else the few directions of common terms make most passages
    look alike.
    """
    k = min(rank + more, len(items.terms))
    test = np.random.default_rng(0).standard_normal((len(items.terms), k)).astype(np.float32)
    weighted = (test * weight[:, None]).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(test.shape)
        for texts in _groups(batches):
            own = Halves(texts, items, weight)
            if not len(own.half):
                continue
            at = own.passages()
            halves, squares = own.sums(weighted), own.sums(weight * weight)
            images = np.zeros_like(halves)
            images[at] = (halves[at] + halves[at + 1]) / (squares[at] + squares[at + 1])[:, None]
            images[1:] += images[:-1].copy()  # a half is in the passages that begin with it and before it
            order = np.argsort(own.term, kind="stable")
            cut = np.flatnonzero(np.diff(own.term[order], prepend=-1, append=len(total)))
            for first, end in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                part = order[first:end]
                total[own.term[part[0]]] += images[own.half[part]].sum(0)
        total = (total * weight[:, None]).astype(np.float32)
        slices = [(i, total[i * SLICE : (i + 1) * SLICE].tobytes()) for i in range(-(-len(total) // SLICE))]
        part, data = zip(*slices, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(data, pa.binary())], names=["part", "data"])

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in parts:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(data, np.float32)
                total[part] = total[part] + x if part in total else x.astype(np.float64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "data"])

    sums = docs.mapInArrow(run, "part int, data binary").repartition("part").mapInArrow(add, "part int, data binary").collect()
    image = np.zeros(test.shape)
    for r in sums:
        image[r.part * SLICE : (r.part + 1) * SLICE] = np.frombuffer(r.data, np.float64).reshape(-1, k)
    q, _ = np.linalg.qr(image)
    small = np.linalg.lstsq((q.T @ test).T, (q.T @ image).T, rcond=None)[0]
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    lead = np.argsort(-values)[:rank]
    lead = lead[values[lead] > 1e-6 * values.max()]
    return (q @ vectors[:, lead] / np.sqrt(values[lead])).astype(np.float32)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the longest common subsequence, a row of the table in the bits of one number."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for mask in filter(None, map(masks.get, b.tolist())):
        hit = row & mask
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def common_run(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the longest run of words that both have.

    Runs of 1, 2, 4 and more words are numbered, each from pairs of those before, as long as both
    have some in common; from the longest such power down, what is left of the length is found by halves.
    """
    if len(a) * len(b) <= 1 << 16:  # as small as most are, the table is quickest row by row
        longest, row = 0, np.zeros(len(b) + 1, np.int64)
        for x in a:
            row[1:] = np.where(b == x, row[:-1] + 1, 0)
            longest = max(longest, int(row.max()))
        return longest
    both = np.concatenate([a, b])
    inside = np.concatenate([np.arange(len(a), 0, -1), np.arange(len(b), 0, -1)])  # words from a place to its text's end

    def shared(number: np.ndarray, length: int) -> bool:
        whole = inside >= length
        return len(np.intersect1d(number[: len(a)][whole[: len(a)]], number[len(a) :][whole[len(a) :]])) > 0

    def longer(number: np.ndarray, length: int, by: np.ndarray) -> np.ndarray:
        later = np.zeros_like(by)
        later[: max(0, len(by) - length)] = by[length:]
        return np.unique(number * (int(by.max(initial=0)) + 1) + later, return_inverse=True)[1]

    number = np.unique(both, return_inverse=True)[1]
    if not len(a) or not len(b) or not shared(number, 1):
        return 0
    powers = [number]
    while shared(next_ := longer(powers[-1], 1 << (len(powers) - 1), powers[-1]), 1 << len(powers)):
        powers.append(next_)
    length, number = 1 << (len(powers) - 1), powers[-1]
    for k in range(len(powers) - 2, -1, -1):
        if shared(more := longer(number, length, powers[k]), length + (1 << k)):
            length, number = length + (1 << k), more
    return length


@dataclass
class Limits:
    """Cosine from which a passage is checked; shares of the item in order, alone or with its answer; words in a row, which are looked up exactly."""

    cosine: float = 0.4
    alone: float = 0.75
    with_answer: float = 0.55
    answer: float = 0.8
    run: int = 13


@dataclass
class Queries:
    """What passages are compared with: items and their pieces as unit vectors, whose they are, the cosine from which each is near, and the runs of all items."""

    own: np.ndarray
    by_gate: np.ndarray  # each divided by the cosine from which it is near
    item: np.ndarray
    whole: np.ndarray  # the places of whole items
    runs: tuple[np.ndarray, np.ndarray]

    @classmethod
    def of(cls, items: Items, weighted: np.ndarray, limits: Limits) -> Queries:
        """The fewer words a query has, the less of a passage they make up, and the lower its gate."""
        pieces, item = items.pieces()
        own = np.stack([weighted[np.searchsorted(items.terms, words)].sum(0) for words in pieces])
        own /= np.maximum(np.sqrt((own**2).sum(1, keepdims=True)), 1e-12)
        gate = limits.cosine * np.sqrt(np.minimum(1, np.array(list(map(len, pieces))) / HALF))
        whole = np.flatnonzero(np.diff(item, prepend=-1))
        return cls(own, (own / gate[:, None]).astype(np.float32), item, whole, items.runs(limits.run))


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt(np.einsum("ij,ij->i", rows, rows)), 1e-12)[:, None]


def near_items(sums: np.ndarray, at: np.ndarray, queries: Queries, at_once: int = 1_000_000) -> Iterator[np.ndarray]:
    """Rows of (half, item): passages that begin there, or their first halves alone, that are near; with about ``at_once`` products in memory.

    The products of a passage are those of its two halves, so each half is multiplied once.
    """
    step = max(1, at_once // len(queries.own))
    for first in range(0, len(at), step):
        part = at[first : first + step]
        used, place = np.unique(np.concatenate([part, part + 1]), return_inverse=True)
        halves = sums[used]
        products = halves @ queries.by_gate.T
        here, there = place[: len(part)], place[len(part) :]
        for second in (False, True):  # the first half alone, then the whole passage
            dot, vectors = products[here], halves[here]
            if second:
                dot += products[there]
                vectors += halves[there]
            length = np.maximum(np.sqrt(np.einsum("ij,ij->i", vectors, vectors)), 1e-12)
            hit, query = np.divmod(np.flatnonzero(dot >= length[:, None]), len(queries.item))
            yield np.column_stack([part[hit], queries.item[query]])


def matches_in(texts: list[bytes], items: Items, weight: np.ndarray, weighted: np.ndarray, queries: Queries, limits: Limits) -> list[tuple]:
    """(text, item, cosine, share in order, answer's share, longest run) of the items that texts hold."""
    found = Halves(texts, items, weight)
    if not len(found.place):
        return []
    sums = found.sums(weighted)
    at = np.union1d(found.passages(), found.half)
    in_runs = found.in_runs(queries.runs, limits.run)
    pairs = np.concatenate([in_runs, *near_items(sums, at, queries)])
    pairs = np.column_stack(np.divmod(np.unique(pairs[:, 1] * found.n_slots + pairs[:, 0]), found.n_slots)[::-1])  # by item, then half
    with_run = set(map(tuple, in_runs.tolist()))
    half, item = pairs[:, 0], pairs[:, 1]
    text, size = np.searchsorted(found.slot, half, side="right") - 1, items.sizes[item]
    begin = (half - found.slot[text]) * HALF
    # Halves that lie close together for a long item are checked as one, in a region that holds theirs.
    close = np.where(size // 8 >= HALF, size // 8, 0)
    own, last = np.ones(len(pairs), bool), (-1, -1, 0)
    for i in np.flatnonzero(close).tolist():
        own[i] = last[:2] != (text[i], item[i]) or begin[i] - last[2] > close[i] or (half[i], item[i]) in with_run
        last = (text[i], item[i], begin[i]) if own[i] else last
    reach = np.maximum(HALF, size) + close  # the longer an item, the further it may go beyond the passage
    first = found.first[text]
    low, high = first + np.maximum(0, begin - reach), first + np.minimum(found.n_words[text], begin + 2 * HALF + reach)
    shared = np.zeros(len(pairs), np.int64)
    short = np.flatnonzero(size <= 64)
    shared[short] = items.in_order(item[short], found.all_terms, *(np.searchsorted(found.place, x[short]) for x in (low, high)))
    for i in np.flatnonzero(own & (size > 64)).tolist():
        words = items.words[item[i]]
        region = found.words[low[i] : high[i]]
        if np.isin(region, words).sum() >= min(limits.with_answer * size[i], limits.run):  # no more can be in order
            shared[i] = common_subsequence(words, region)
    best: dict[tuple[int, int], tuple] = {}
    for i in np.flatnonzero(own & ((shared >= limits.with_answer * size) | (shared >= limits.run))).tolist():
        h, k, t, order = int(half[i]), int(item[i]), int(text[i]), float(shared[i] / size[i])
        runs = (h, k) in with_run
        if order < limits.with_answer and not runs:
            continue
        region = found.words[low[i] : high[i]]
        answer = common_subsequence(items.answers[k], region) / len(items.answers[k])
        if order >= limits.alone or order >= limits.with_answer and answer >= limits.answer or runs:
            cosine = float(unit(sums[h : h + 1] + sums[h + 1 : h + 2])[0] @ queries.own[queries.whole[k]])
            best[t, k] = max(best.get((t, k), (0, 0, 0, 0)), (order, cosine, answer, common_run(items.words[k], region)))
    return [(t, items.ids[k], cosine, order, answer, run) for (t, k), (order, cosine, answer, run) in best.items()]


@dataclass
class Search:
    """All that a task needs to find a block's items in texts."""

    items: Items
    weight: np.ndarray
    weighted: np.ndarray
    queries: Queries
    limits: Limits

    def matches(self, texts: list[bytes]) -> Iterator[tuple]:
        """(place in the list, item, cosine, share in order, answer's share, longest run)."""
        for first, group in in_groups(texts):
            if len(group[0]) <= LONG_TEXT:
                for t, *found in self._found(group):
                    yield first + t, *found
                continue
            # Parts overlap by as much as a region can span.
            overlap = 3 * int(self.items.sizes.max()) + 4 * HALF
            best: dict[int, tuple] = {}
            for part in parts_of(group[0], max(PART, 2 * overlap), overlap):
                for _, item, cosine, order, answer, run in self._found([part]):
                    best[item] = max(best.get(item, (0, 0, 0, 0)), (order, cosine, answer, run))
            for item, (order, cosine, answer, run) in best.items():
                yield first, item, cosine, order, answer, run

    def _found(self, texts: list[bytes]) -> list[tuple]:
        return matches_in(texts, self.items, self.weight, self.weighted, self.queries, self.limits)


def searches(df: DataFrame, benchmark: DataFrame, text: str = "text", block: int = 5000, block_bytes: int = 8 << 20, block_terms: int = 200_000, limits: Limits = Limits()) -> Iterator[Search]:
    """The benchmark is the stated query set: its items go to all documents in blocks of about ``block`` items and ``block_bytes`` of text, each with terms, weights and a space of its own.

    A task holds some 1 KB for each term of a block, so that there are as many blocks as share the
    benchmark's distinct words out by ``block_terms``.
    """
    texts = df.select(text_bytes(F.col(f"`{text}`")).alias("text"))
    size = benchmark.where("item_id is not null").agg(F.countDistinct("item_id").alias("n"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes")).first()
    words = benchmark.where("item_id is not null").select(F.explode(F.split(F.lower(F.col("text").cast("string")), r"[ \t\n\x0b\x0c\r]+")).alias("word"))
    terms = words.agg(F.approx_count_distinct("word").alias("n")).first()["n"]
    blocks = max(-(-size["n"] // block), -(-size["bytes"] // block_bytes), -(-terms // block_terms)) if size["n"] else 0
    for b in range(blocks):
        own_rows = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).select("item_id", F.col("text").cast("string"))
        items = Items.of(sorted({(r[0], r[1] or "") for r in own_rows.distinct().collect() if r[0] is not None}))
        if items is None:
            continue
        n, held = halves_with(texts, items)
        if not n:
            continue
        weight = term_weights(items, n, held)
        weighted = (latent_space(texts, items, weight) * weight[:, None]).astype(np.float32)
        yield Search(items, weight, weighted, Queries.of(items, weighted, limits), limits)


FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.float64()), ("run", pa.int64())])


def find_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", limits: Limits = Limits(), **sizes: int) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer, run) for every document and item that it holds, whole or reworded.

    ``sizes`` bounds the blocks of items: see ``searches``. Null and empty texts hold nothing;
    repeated documents give repeated rows; a share just at a limit counts; without documents or
    items there are no rows.
    """
    schema = "doc_id long, item_id long, cosine double, lcs double, answer double, run long"
    out = None
    for search in searches(df, benchmark, text, limits=limits, **sizes):

        def run(batches: Iterator[pa.RecordBatch], search=search) -> Iterator[pa.RecordBatch]:
            for batch in in_slices(batches):
                doc_ids = batch.column(0).to_pylist()
                rows = [(doc_ids[t], *found) for t, *found in search.matches(batch.column(1).to_pylist())]
                columns = list(zip(*rows, strict=True)) or [[]] * len(FOUND)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND, strict=True)], schema=FOUND)

        found = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_bytes(F.col(f"`{text}`"))).mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return df.sparkSession.createDataFrame([], schema) if out is None else out


def remove_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", limits: Limits = Limits(), **sizes: int) -> DataFrame:
    """The rows that hold no benchmark item, with all their columns, whatever their names.

    Each row is judged by its own text, where it is: nothing is joined, so rows with equal or null
    ids do not go for one another. Null and empty texts stay, repeated rows stay or go together,
    and without documents or items all rows stay.
    """
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), text_bytes(F.col(f"`{text}`")).alias("text"))
    schema = rows.schema
    for search in searches(df, benchmark, text, limits=limits, **sizes):

        def run(batches: Iterator[pa.RecordBatch], search=search) -> Iterator[pa.RecordBatch]:
            for batch in in_slices(batches):
                clean = np.ones(len(batch), bool)
                clean[[found[0] for found in search.matches(batch.column(1).to_pylist())]] = False
                yield batch.filter(pa.array(clean))

        rows = rows.mapInArrow(run, schema)
    return rows.select("row.*")


def op7_latent_retrieval(spark, sf_dir: str) -> DataFrame:
    """The benchmark items that documents hold, by document."""
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
