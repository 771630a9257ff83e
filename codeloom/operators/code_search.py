"""Search for code by texts: similar line chunks, and files that keywords relate to."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.embedding import model_of
from codeloom.operators import vectors
from codeloom.schema import AnalysisType

PLACE = ["file_path", "start_line", "end_line"]


def checked(texts: list[str] | str | None, top_k: int = 10) -> list[str]:
    """The texts of a request without blank ones; an error where none is left, or ``top_k`` is not from 1 to 100."""
    if isinstance(top_k, bool) or not isinstance(top_k, int) or not 1 <= top_k <= 100:
        raise ValueError("top_k must be a whole number from 1 to 100")
    kept = [t.strip() for t in ([texts] if isinstance(texts, str) else texts or []) if t and t.strip()]
    if not kept:
        raise ValueError("a request needs a text that is not blank")
    return kept


def centroid_of(texts: list[str], dim: int, model: str) -> list[float]:
    """The mean of the texts' vectors: the few texts of a request are embedded at once."""
    return np.mean(np.asarray(model_of(model)(texts, dim), np.float64), axis=0).tolist()


def _nearest(space: DataFrame, repo_id: str, kind: AnalysisType, query: list[float], top_k: int) -> DataFrame:
    own = space.where((F.col("repo_id") == repo_id) & (F.col("analysis_type") == kind.value))
    return vectors.knn(own.select("id", *PLACE, "vec"), "vec", vectors.vector_literal(query), top_k, "id")


def similar_code(chunks: DataFrame, repo_id: str, text: str, top_k: int = 10, dim: int = 64, model: str = "hashed_words") -> DataFrame:
    """(id, file_path, start_line, end_line, score) of the line chunks most similar to a text."""
    query = centroid_of(checked(text, top_k), dim, model)
    return _nearest(chunks, repo_id, AnalysisType.LINE_CHUNK, query, top_k)


def related_files(symbols: DataFrame, chunks: DataFrame, repo_id: str, keywords: list[str], top_k: int = 10, dim: int = 64, model: str = "hashed_words") -> DataFrame:
    """(file_path, start_line, end_line, score, src): the symbols nearest to the mean of the keywords, then the chunks; a place that both have counts for the symbols."""
    query = centroid_of(checked(keywords, top_k), dim, model)
    lists = [_nearest(df, repo_id, kind, query, top_k) for df, kind in ((symbols, AnalysisType.SYMBOL_SUMMARY), (chunks, AnalysisType.LINE_CHUNK))]
    found = vectors.related(lists, PLACE, [F.desc("score"), "id"])
    return found.select(*PLACE, "score", "src").orderBy("src", F.desc("score"), *PLACE)
