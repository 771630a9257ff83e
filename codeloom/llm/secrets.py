"""Secret scans: fixed patterns, and strings that a tokenizer's vocabulary can hardly compress.

Words and identifiers come to several characters a token; random keys come to fewer than two. So
long strings of key characters are encoded with a public vocabulary, and a low ratio is reported,
unless the string is a digest of a known length, a UUID, a number or made of plain words. Whether
letters are a word is up to the vocabulary too. Where words dilute a key, as in a path, the ratio is
taken of the parts between marks, and of stretches of tokens within a part.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import in_slices
from codeloom.sources.tables import read_table

KINDS = ("assign", "access", "hex", "random")
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The pattern that cuts texts into pieces for this vocabulary.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = (b"passw", b"secret", b"token", b"api")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
DIGEST_LENGTHS = frozenset({32, 40, 56, 64, 96, 128})
UUID = r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}"
KNOWN = re.compile(UUID + r"|[0-9+/_=-]+")
JOINED = re.compile(r"(?:[A-Za-z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?:[-_/=+]+(?:[A-Za-z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*")
LETTERS = re.compile(r"[A-Za-z]+")
PART = re.compile(rf"(?<![0-9A-Za-z]){UUID}(?![0-9A-Za-z])|[0-9A-Za-z]+")
LEAST = 16  # characters of a key
HEX_ANY_CASE = re.compile(r"[0-9A-Fa-f]+")
CHUNK = 512


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def chars_per_token(string: str, vocabulary: str = VOCABULARY) -> float:
    """Long strings are encoded in chunks, as one piece takes time that grows faster than its length."""
    own = encoder(vocabulary)
    return len(string) / sum(len(own.encode_ordinary(string[i : i + CHUNK])) for i in range(0, len(string), CHUNK))


@lru_cache(maxsize=1 << 16)
def is_word(letters: str, threshold: float, vocabulary: str) -> bool:
    """Letters that come to several characters a token; a single letter is no key either, however often it is repeated."""
    return len(set(letters)) == 1 or chars_per_token(letters, vocabulary) >= threshold


def is_known(string: str, threshold: float = 1.95, vocabulary: str = VOCABULARY) -> bool:
    """Digests of known lengths, UUIDs, numbers, and words joined by marks and short numbers."""
    if len(string) in DIGEST_LENGTHS and HEX_ANY_CASE.fullmatch(string) or KNOWN.fullmatch(string):
        return True
    return bool(JOINED.fullmatch(string)) and all(is_word(x, threshold, vocabulary) for x in LETTERS.findall(string))


def low_within(part: str, threshold: float, vocabulary: str) -> list[tuple[int, int]]:
    """(start, end) of the stretches of tokens, joined where they meet, in which every ``LEAST`` characters come to a low ratio."""
    own = encoder(vocabulary)
    tokens = [own.decode_single_token_bytes(t) for i in range(0, len(part), CHUNK) for t in own.encode_ordinary(part[i : i + CHUNK])]
    at = [0, *accumulate(map(len, tokens))]
    out: list[tuple[int, int]] = []
    end = 0
    for first in range(len(tokens)):
        while end < len(tokens) and at[end] - at[first] < LEAST:
            end += 1
        size = at[end] - at[first]
        if size >= LEAST and size / (end - first) < threshold and len(set(part[at[first] : at[end]])) > 1:
            if out and at[first] <= out[-1][1]:
                out[-1] = out[-1][0], at[end]
            else:
                out.append((at[first], at[end]))
    return [(a, b) for a, b in out if not is_known(part[a:b], threshold, vocabulary)]


def low_parts(string: str, threshold: float, vocabulary: str) -> list[tuple[int, int]]:
    """(start, end) of what is low in a string that is not low as a whole.

    Adjacent parts that are low are one stretch, also across a short part that is not, and it is
    reported if it is as long as a key and low parts are half of it.
    """
    out: list[tuple[int, int]] = []
    stretch: list[tuple[int, int]] = []  # low parts
    between = 0  # characters of other parts since the last low one

    def close() -> None:
        if stretch:
            a, b = stretch[0][0], stretch[-1][1]
            enough = b - a >= LEAST and 2 * sum(y - x for x, y in stretch) >= b - a
            if enough and chars_per_token(string[a:b], vocabulary) < threshold and not is_known(string[a:b], threshold, vocabulary):
                out.append((a, b))
        stretch.clear()

    for m in PART.finditer(string):
        part, (a, b) = m[0], m.span()
        if not is_known(part, threshold, vocabulary) and chars_per_token(part, vocabulary) < threshold:
            stretch.append((a, b))
            between = 0
            continue
        between += len(part)
        if between > 6:
            close()
        if len(part) > LEAST and not is_known(part, threshold, vocabulary):
            out += [(a + x, a + y) for x, y in low_within(part, threshold, vocabulary)]
    close()
    return sorted(out)


def find(text: str | None, threshold: float = 1.95, vocabulary: str = VOCABULARY) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind. A null or empty text has none."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    found: list[tuple[int, int, int]] = []
    small = raw.lower()
    if any(x in small for x in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if max(map(len, raw.split()), default=0) >= 16:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        for m in CANDIDATE.finditer(text):
            if is_known(m[0], threshold, vocabulary):
                continue
            low = [(0, len(m[0]))] if chars_per_token(m[0], vocabulary) < threshold else low_parts(m[0], threshold, vocabulary)
            found += [(m.start() + a, 3, m.start() + b) for a, b in low]
    return [(KINDS[k], start, end) for start, k, end in sorted(found)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(df: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 1.95, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each row of ``df``: its id, counts of spans by kind, and the spans as text.

    Null texts count as empty. Repeated rows give repeated results; a null id stays null; an empty
    table gives no rows. The id keeps its column's name, or is called doc_id where that is a name of
    the results. Every executor must be able to read the vocabulary file.
    """
    name = "doc_id" if doc_id in {*[f"n_{k}" for k in KINDS], "base_sha256", "spans"} else doc_id
    fields = pa.schema([(name, pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            rows = [find(t, threshold, vocabulary) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in r) for r in rows], pa.int64()) for k in KINDS]
            digests = [hashlib.sha256(joined([s for s in r if s[0] != "random"]).encode()).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(digests, pa.string()), pa.array([joined(r) for r in rows], pa.string())], schema=fields
            )

    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    source = df.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return source.mapInArrow(run, f"`{name}` long, {kinds}, base_sha256 string, spans string")


def redacted(text: str | None, threshold: float = 1.95, vocabulary: str = VOCABULARY, mark: str = "[SECRET]") -> str | None:
    """The text with every span, or union of spans that overlap, replaced by a mark."""
    out, end = [], 0
    for _, start, stop in find(text, threshold, vocabulary):
        if start >= end:
            out += [text[end:start], mark]
        end = max(end, stop)
    return "".join([*out, text[end:]]) if out else text


def redact(df: DataFrame, text: str = "text", threshold: float = 1.95, vocabulary: str = VOCABULARY) -> DataFrame:
    """All rows, with the secrets in their texts replaced; other columns stay as they are, whatever their names.

    Null and empty texts stay so. Spans that overlap become one mark. Rows that repeat are changed
    alike; an empty table gives no rows. Every executor must be able to read the vocabulary file.
    """
    clean = F.pandas_udf(lambda s: s.map(lambda t: redacted(t, threshold, vocabulary)), "string")
    return df.withColumn(text, clean(F.col(f"`{text}`").cast("string")))


def op2_token_efficiency(spark, sf_dir: str) -> DataFrame:
    """The secrets in every document."""
    return scan(read_table(spark, sf_dir, "documents"))
