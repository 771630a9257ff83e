"""Language of texts, word by word: scripts narrow the candidates, and a Viterbi path with a penalty for each switch labels spans.

A word's score in a language adds up the log shares of its 1 to 4 characters and of the word itself
among the language's sample. Only languages that write in the word's script are candidates. The path
through the words of a text with the best sum, less a penalty for every change of language, gives
the spans; the language with the most letters is the text's.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import in_slices
from codeloom.llm.ngrams import mix
from codeloom.sources.tables import read_table

#: The Unicode ranges of letters and marks by script.
SCRIPTS = {
    "latin": "A-Za-z\u00aa\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u0300-\u036f\u1e00-\u1eff",
    "greek": "\u0370-\u037d\u037f-\u03ff\u1f00-\u1ffe",
    "cyrillic": "\u0400-\u052f",
    "armenian": "\u0531-\u0556\u0559-\u0588",
    "hebrew": "\u0591-\u05bd\u05d0-\u05f2",
    "arabic": "\u0610-\u061a\u0620-\u065f\u066e-\u06d3\u06d5-\u06dc\u06e1-\u06e8\u06ea-\u06ef\u06fa-\u06ff\u0750-\u077f",
    "devanagari": "\u0900-\u0963\u0971-\u097f",
    "bengali": "\u0980-\u09e3",
    "gurmukhi": "\u0a01-\u0a5e",
    "gujarati": "\u0a81-\u0ae3",
    "tamil": "\u0b82-\u0bd7",
    "telugu": "\u0c00-\u0c63",
    "kannada": "\u0c80-\u0ce3",
    "malayalam": "\u0d00-\u0d63",
    "thai": "\u0e01-\u0e3a\u0e40-\u0e4e",
    "georgian": "\u10a0-\u10ff",
    "ethiopic": "\u1200-\u135a",
    "hangul": "\u1100-\u11ff\u3131-\u318e\uac00-\ud7a3",
    "kana": "\u3041-\u309f\u30a1-\u30fa\u30fc-\u30ff",
    "han": "\u3005\u3007\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0002fa1f",
}
#: A run of one script's letters, or of letters of none of these.
WORD = re.compile("|".join(f"[{ranges}]+" for ranges in SCRIPTS.values()) + r"|[^\W\d_]+")
_NAMES = [*SCRIPTS, "other"]
_RANGES = sorted((m[0], m[-1], k) for k, ranges in enumerate(SCRIPTS.values()) for m in re.findall(".-.|.", ranges, re.DOTALL))
_LOW, _HIGH = (np.array([ord(r[i]) for r in _RANGES]) for i in (0, 1))
_SCRIPT = np.array([r[2] for r in _RANGES])

BITS = 17
#: A word counts at most this much against a language, and twice as much where the language has another script.
CLIP = 6.0
UNSEEN = 1e-6
SPACE = re.compile(r"\s")


def scripts_of(words: list[str]) -> np.ndarray:
    """The script of every word's first character, by number; the last number stands for all others."""
    code = np.array([ord(w[0]) for w in words], np.int64)
    k = np.maximum(np.searchsorted(_LOW, code, "right") - 1, 0)
    return np.where((code >= _LOW[k]) & (code <= _HIGH[k]), _SCRIPT[k], len(_NAMES) - 1)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed gram, index of its word) of lower-case words: 1 to 4 characters, word ends included, and the whole word."""
    code = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    space = code == 32
    owner = np.cumsum(space) - 1
    found, whose = [], []
    for n in range(1, 5):
        if n > len(code):
            break
        h, whole = code[: len(code) - n + 1].copy(), np.ones(len(code) - n + 1, bool)
        for j in range(1, n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + code[j : len(code) - n + 1 + j]
            if j < n - 1:
                whole &= ~space[j : len(code) - n + 1 + j]
        # One character must be a letter; of two, not both may be ends of words.
        whole &= ~space[: len(h)] if n == 1 else ~(space[: len(h)] & space[1 : len(h) + 1])
        found.append(mix(h[whole] + np.uint64(n << 56)) >> np.uint64(64 - BITS))
        whose.append(owner[: len(h)][whole])
    found.append(np.array([xxhash.xxh3_64_intdigest(w.encode()) >> (64 - BITS) for w in words], np.uint64))
    whose.append(np.arange(len(words)))
    return np.concatenate(found).astype(np.int64), np.concatenate(whose)


def in_pieces(text: str, size: int = 1 << 16) -> Iterator[tuple[int, str]]:
    """(offset, piece) of a text: all of it, or pieces of about ``size`` characters cut at white space."""
    start = 0
    while len(text) - start > size:
        m = SPACE.search(text, start + size)
        if not m:
            break
        yield start, text[start : m.start()]
        start = m.start()
    yield start, text[start:]


def count_grams(texts: Iterator[str]) -> tuple[np.ndarray, np.ndarray]:
    """(occurrences of every hashed gram, letters by script) of texts."""
    words: Counter[str] = Counter()
    for text in texts:
        for _, piece in in_pieces(text):
            words.update(w.lower() for w in WORD.findall(piece))
    n, letters = np.zeros(1 << BITS), np.zeros(len(_NAMES))
    if not words:
        return n, letters
    names, times = list(words), np.array(list(words.values()), np.float64)
    for first in range(0, len(names), 50_000):
        part, w = names[first : first + 50_000], times[first : first + 50_000]
        found, whose = grams(part)
        n += np.bincount(found, w[whose], 1 << BITS)
        letters += np.bincount(scripts_of(part), w * [len(x) for x in part], len(_NAMES))
    return n, letters


def viterbi(score: np.ndarray, words: np.ndarray, first: np.ndarray, n: np.ndarray, penalty: float) -> np.ndarray:
    """The label of every word on the best paths through many lanes at once.

    ``words`` are rows of ``score``; lane i has the ``n[i]`` words from ``first[i]`` on. A step takes
    the words at one place of all lanes that reach it. Of equal labels the first is taken, and a
    path stays where it is rather than switch for nothing.
    """
    labels = np.zeros(len(words), np.int16)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    if not len(order):
        return labels
    first, n = first[order], n[order]
    active = len(n) - np.searchsorted(n[::-1], np.arange(n[0]), "right")
    back = np.empty((len(words), score.shape[1]), np.uint8 if score.shape[1] <= 256 else np.int16)
    own = np.arange(score.shape[1])
    last = np.zeros(len(n), np.int64)
    v = score[words[first]].astype(np.float64)
    for t in range(1, n[0]):
        k = active[t]
        if k < len(v):
            last[k : len(v)] = v[k:].argmax(1)
            v = v[:k]
        at = first[:k] + t
        best = v.argmax(1)
        top = v[np.arange(k), best] - penalty
        stay = v >= top[:, None]
        back[at] = np.where(stay, own, best[:, None])
        v = np.where(stay, v, top[:, None]) + score[words[at]]
    last[: len(v)] = v.argmax(1)
    state = last
    for t in range(n[0] - 1, -1, -1):
        at = first[: active[t]] + t
        now = state[: active[t]]
        labels[at] = now
        if t:
            state[: active[t]] = back[at, now]
    return labels


class Model:
    """Languages, the log share of every hashed gram in each, and which of them write in which script."""

    def __init__(self, langs: list[str], n: np.ndarray, letters: np.ndarray, penalty: float, least: float = 0.1):
        self.langs, self.penalty = langs, penalty
        self.table = np.log(n / np.maximum(1, n.sum(1, keepdims=True)) + UNSEEN).T.astype(np.float32)
        share = letters / np.maximum(1, letters.sum(1, keepdims=True))
        self.writes = (share >= least).T
        # A script that no language has much of is left to those that have some, and else to all.
        for k in np.flatnonzero(~self.writes.any(1)):
            self.writes[k] = share[:, k] > 0 if (share[:, k] > 0).any() else True
        self._words: dict[str, int] = {}
        self._score = np.zeros((0, len(langs)), np.float32)
        self._letters = np.zeros(0, np.int32)

    def __getstate__(self):
        return self.__dict__ | {"_words": {}, "_score": self._score[:0], "_letters": self._letters[:0]}

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Scores of words by language, 0 for the best candidate and down to ``-CLIP``; twice that for languages of other scripts."""
        out = np.empty((len(words), len(self.langs)), np.float32)
        low = [w.lower() for w in words]
        step, first = max(1, (1 << 19) // len(self.langs)), 0
        while first < len(low):
            size, end = 0, first
            while end < len(low) and (end == first or size + len(low[end]) <= step):
                size, end = size + len(low[end]), end + 1
            found, whose = grams(low[first:end])
            s = np.stack([np.bincount(whose, self.table[found, k], end - first) for k in range(len(self.langs))], 1) / 2
            can = self.writes[scripts_of(low[first:end])]
            s -= np.where(can, s, -np.inf).max(1, keepdims=True)
            out[first:end] = np.where(can, np.maximum(s, -CLIP), -2 * CLIP)
            first = end
        return out

    def numbers(self, words: list[str]) -> np.ndarray:
        """Numbers of words whose scores are known afterwards."""
        known = self._words
        new = list(set(words).difference(known))
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self._score = np.concatenate((self._score, self.word_scores(new)))
            self._letters = np.concatenate((self._letters, np.array([sum(map(str.isalpha, w)) for w in new], np.int32)))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def label(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(label of every word, its letters, how many words each piece has). Words without a letter count nothing."""
        if len(self._words) * len(self.langs) > 1 << 21:
            self.__dict__.update(self.__getstate__())
        found = [self.numbers(WORD.findall(p)) for p in pieces]
        n = np.array([len(x) for x in found], np.int64)
        words = np.concatenate(found) if found else np.zeros(0, np.int64)
        letters = self._letters[words]
        score = self._score if letters.all() else np.where(self._letters[:, None] > 0, self._score, 0)
        return viterbi(score, words, np.cumsum(n) - n, n, self.penalty), letters, n

    def groups(self, texts: list[str], size: int = 8 << 20) -> Iterator[tuple[list[int], list[int], list[str]]]:
        """(text's index, offset, piece) lists of neighbouring pieces that come to about so many characters, fewer with many languages."""
        most = max(1 << 18, min(size, (size << 2) // len(self.langs)))
        own, at, pieces, held = [], [], [], 0
        for i, text in enumerate(texts):
            for offset, piece in in_pieces(text):
                own.append(i)
                at.append(offset)
                pieces.append(piece)
                held += len(piece)
                if held >= most:
                    yield own, at, pieces
                    own, at, pieces, held = [], [], [], 0
        if pieces:
            yield own, at, pieces


def train(docs: DataFrame, max_docs: int = 1000, max_bytes: int = 8 << 20, max_langs: int = 128, penalty: float = 8.0, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model | None:
    """Learn from at most ``max_docs`` whole documents and ``max_bytes`` of text in each language, of the ``max_langs`` languages with the most documents.

    The sample are the rows with the smallest hashes of id and text, as long as they fit. Rows whose
    language or text is null are left out; None where there are none. Languages are in the order of
    how many documents they have, then by name, so that a text without evidence is given the most
    common one. A task holds one language's sample; its counts alone reach the driver.
    """
    own = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"), F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("h"))
    own = own.where("lang is not null and text is not null")
    sizes = own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    if not sizes:
        return None
    # About four times as many rows as are wanted have hashes this low; only these are sorted.
    upto = {r["lang"]: min((1 << 63) - 1, int((2 * min(1.0, 4 * max_docs / r["count"]) - 1) * (1 << 63))) for r in sizes}
    limit = F.create_map(*[F.lit(x) for pair in upto.items() for x in pair])
    order = Window.partitionBy("lang").orderBy("h", "text")
    sample = own.where(F.col("h") <= limit[F.col("lang")]).where(F.octet_length("text") <= max_bytes)
    sample = sample.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= max_docs)
    sample = sample.withColumn("upto", F.sum(F.octet_length("text").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") <= max_bytes)

    def run(rows: pa.Table) -> pa.Table:
        n, letters = count_grams(t.as_py() for t in rows["text"])
        return pa.table({"lang": pa.array([rows["lang"][0].as_py()]), "n": pa.array([n.astype(np.float32).tobytes()], pa.binary()), "letters": pa.array([letters.tolist()], pa.list_(pa.float64()))})

    found = {r["lang"]: r for r in sample.select("lang", "text").groupBy("lang").applyInArrow(run, "lang string, n binary, letters array<double>").collect()}
    langs = [r["lang"] for r in sizes if r["lang"] in found]
    if not langs:
        return None
    return Model(langs, np.stack([np.frombuffer(found[x].n, np.float32) for x in langs]).astype(np.float64), np.array([found[x].letters for x in langs]), penalty)


def identify(docs: DataFrame, model: Model | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score, n_letters) for every row.

    The language is the one whose spans have most letters, the first in the model's order of equal
    ones, and the score is its share of the text's letters. Texts that are null or have no letter,
    and all texts if there is no model, are ``und`` with score 0. Texts over 65,536 characters are
    labelled in pieces, each by itself, and counted as a whole. Repeated rows give repeated results;
    an empty table gives no rows; other columns do not matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 10_000):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            letters = np.zeros((len(texts), len(model.langs) if model else 1))
            for own, _, pieces in model.groups(texts) if model else ():
                label, weight, n = model.label(pieces)
                cell = np.repeat(np.array(own), n) * letters.shape[1] + label
                letters += np.bincount(cell, weight, letters.size).reshape(letters.shape)
            best, total = letters.argmax(1), letters.sum(1)
            score = letters[np.arange(len(texts)), best] / np.maximum(total, 1)
            lang = [model.langs[b] if t else "und" for b, t in zip(best, total, strict=True)] if model else ["und"] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(total.astype(np.int64))], names=["doc_id", "lang_pred", "score", "n_letters"])

    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, n_letters long")


def label_spans(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, spans) for every row: start and end (exclusive, in characters) of each run of words of one language, in order.

    Words without a letter belong to no span; a null or empty text has none.
    """

    def spans_of(text: str) -> list[dict]:
        out: list[dict] = []
        for _, at, pieces in model.groups([text]):
            label, letters, n = model.label(pieces)
            k = 0
            for offset, piece, count in zip(at, pieces, n.tolist(), strict=True):
                for j, m in enumerate(WORD.finditer(piece), k):
                    lang = model.langs[label[j]]
                    if not letters[j]:
                        continue
                    if out and out[-1]["lang"] == lang:
                        out[-1]["end"] = offset + m.end()
                    else:
                        out.append({"start": offset + m.start(), "end": offset + m.end(), "lang": lang})
                k += count
        return out

    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([spans_of(t or "") for t in batch.column(1).to_pylist()], kind)], names=["doc_id", "spans"])

    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, spans array<struct<start:bigint,end:bigint,lang:string>>")


def op13_viterbi_spans(spark, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those that are not held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    model = train(docs.where(~held))
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "n_letters")
