"""Tokens of a public vocabulary: counts, and texts cut to a number of them."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that cuts texts into pieces for this vocabulary.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str = PATH):
    """Once for each worker; every executor must be able to read the file."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: Column, path: str = PATH) -> Column:
    """Null counts as empty."""
    return F.pandas_udf(lambda s: pd.Series([len(encoding(path).encode_ordinary(t or "")) for t in s], dtype="int64"), "long")(text)


def cut(text: Column, most: int, path: str = PATH) -> Column:
    """The first ``most`` tokens of a text; a character that the cut would split goes."""

    def one(t: str | None) -> str | None:
        own = encoding(path)
        tokens = own.encode_ordinary(t) if t else []
        return t if len(tokens) <= most else own.decode_bytes(tokens[:most]).decode("utf-8", "ignore")

    return F.pandas_udf(lambda s: pd.Series(map(one, s), dtype=object), "string")(text)
