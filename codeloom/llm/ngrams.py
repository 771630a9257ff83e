"""Words of a text as 64-bit hashes, computed on whole byte arrays.

Short words are hashed by a polynomial and a finaliser. Polynomials modulo 2^64 collide for long
words of certain structures whatever their base, so words of 128 bytes or more are hashed one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

from codeloom.llm.common import WHITE_SPACE

_BASE = 0x9E3779B97F4A7C15 | 1
_UNDO = pow(_BASE, -1, 1 << 64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(WHITE_SPACE)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)
LONG = 128

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """The base and its inverse modulo 2^64, to all powers below n at least."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 17)
        for k, x in enumerate((_BASE, _UNDO)):
            p = np.full(size, x, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(raw: np.ndarray, fold: np.ndarray = SAME) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word in an array of UTF-8 bytes; ``fold`` maps each byte before it is hashed."""
    space = np.ones(len(raw) + 2, bool)
    space[1:-1] = IS_SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    p, undo = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    terms = sums[1:]
    terms[:] = raw if fold is SAME else fold[raw]
    terms += np.uint64(1)
    terms *= p[: len(raw)]
    np.cumsum(terms, out=terms)
    found = mix((sums[end] - sums[start]) * undo[start] + (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start >= LONG).tolist():
        found[i] = xxhash.xxh3_64_intdigest(fold[raw[start[i] : end[i]]].tobytes())
    return found, start, end


def in_groups(texts: list[bytes], most: int = 2 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) of groups of neighbouring texts that come to about ``most`` bytes, or of one longer text."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > most:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, texts[first:]


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all words, where each text's words begin, how many it has), computed for all texts at once."""
    hashes, start, _ = word_hashes(np.frombuffer(b"\n".join(texts), np.uint8))
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    first = np.searchsorted(start, bounds)
    return hashes, first[:-1], np.diff(first)
