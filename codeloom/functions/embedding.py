"""Symbols as texts with vectors: low-information symbols, summaries, and an offline embedder.

The embedder is a pure function: signed hashed counts of words, of length one. Another model can be
registered under a name; it gets each distinct text once, in batches.
"""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import fallback_summary, stable_id
from codeloom.sources.scratch import materialize

_models: dict[str, Callable[[list[str], int], np.ndarray]] = {}


def hashed_words(texts: list[str], dim: int) -> np.ndarray:
    out = np.zeros((len(texts), dim), np.float32)
    for i, text in enumerate(texts):
        for word in text.lower().split():
            h = crc32(word.encode())
            out[i, h % dim] += 1 - 2 * (h >> 31)
        norm = np.linalg.norm(out[i])
        out[i] /= norm if norm else 1
    return out


_models["hashed_words"] = hashed_words


def register_model(name: str, model: Callable[[list[str], int], np.ndarray]) -> None:
    _models[name] = model


def model_of(name: str) -> Callable[[list[str], int], np.ndarray]:
    """An unknown name stands for the built-in one."""
    return _models.get(name, hashed_words)


def embed(df: DataFrame, text: str, dim: int = 64, model: str = "hashed_words", to: str = "vec", batch: int = 96) -> DataFrame:
    """Add the vector of each text. Texts are deduplicated first and joined back, so ``df`` is read twice; unknown models fall back to the built-in one."""
    encode = model_of(model)

    def run(texts: pd.Series) -> pd.Series:
        parts = [encode(texts[i : i + batch].tolist(), dim) for i in range(0, len(texts), batch)]
        out = [v.tolist() for p in parts for v in p]
        if len(out) != len(texts):
            raise ValueError("the model gave another number of vectors")
        return pd.Series(out)

    distinct = df.select(F.coalesce(text, F.lit("")).alias("__text")).distinct()
    vectors = distinct.withColumn(to, F.pandas_udf(run, "array<float>")("__text"))
    return df.withColumn("__text", F.coalesce(text, F.lit(""))).join(vectors, "__text").drop("__text")


def low_information(source: Column, language: Column, name: Column) -> Column:
    """Short accessors, by language: what is left of the lines without blanks and comments is few."""
    lines = F.filter(F.transform(F.split(source, "\n"), lambda s: F.trim(s)), lambda s: (s != "") & ~s.rlike(r"^(#|//|/\*|\*)"))
    n = F.size(lines)
    py = (language == "python") & name.rlike("^(get_|set_|is_)") & source.contains("return") & (n <= 4)
    go = (language == "go") & name.rlike("^(Get|Set|Is)") & (n <= 5)
    braced = language.isin("java", "c", "cpp") & name.rlike("^(get|set|is)[A-Z_]") & (n <= 7)
    return py | go | braced


def symbol_summaries(symbols: DataFrame, repo_id: str, dim: int = 64) -> DataFrame:
    """Records for the symbol space, from symbols with path, kind, name, class_name, source, start_line, end_line. They are written to a scratch table, so that the files are parsed once."""
    name = F.concat_ws(".", "class_name", "name")
    kept = symbols.where((F.trim("source") != "") & ~low_information(F.col("source"), F.lit("python"), F.col("name")))
    rows = kept.select(
        stable_id(F.lit(repo_id), F.col("path"), F.lit("symbol_summary_vector"), F.col("start_line"), F.col("end_line"), name).alias("id"),
        F.lit(repo_id).alias("repo_id"), F.col("path").alias("file_path"), F.lit("symbol_summary_vector").alias("analysis_type"),
        F.col("kind").alias("symbol_kind"), name.alias("symbol_name"), "start_line", "end_line",
        fallback_summary(F.concat("kind", F.lit(" "), name, F.lit(": ")), F.col("source")).alias("summary"),
    )
    return embed(materialize(rows, "summaries"), "summary", dim)


def chunk_records(chunks: DataFrame, repo_id: str, dim: int = 64) -> DataFrame:
    """Records for the chunk space, from (path, start_line, end_line, content), by way of a scratch table."""
    from pyspark.sql import Window

    index = F.row_number().over(Window.partitionBy("path").orderBy("start_line")) - 1
    rows = chunks.withColumn("chunk_index", index).select(
        stable_id(F.lit(repo_id), F.col("path"), F.lit("line_chunk_vector"), F.col("start_line"), F.col("end_line"), F.col("chunk_index")).alias("id"),
        F.lit(repo_id).alias("repo_id"), F.col("path").alias("file_path"), F.lit("line_chunk_vector").alias("analysis_type"),
        "start_line", "end_line", "chunk_index", "content",
    )
    return embed(materialize(rows, "chunks"), "content", dim)
