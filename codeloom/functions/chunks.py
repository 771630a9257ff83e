"""Line chunks of source files, over Arrow batches and as a table function of SQL.

Windows of a few lines with an overlap. A window grows while its last line continues, a bracket
stays open, or, in Python, a block follows a colon. Chunks of little value are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET, OVERLAP, LONGEST = 5, 1, 200

# What headers, accessors and plain returns look like.
HEADER = re.compile(r"(?ms)^\s*((package\s+[\w\.]+;|import\s+[\w\.\*]+;|using\s+namespace\s+\w+\s*;|#include\s+[<\"].+[>\"]|module\s+\w+).*)$")
PY_GETTER = re.compile(r"^\s*def\s+(get|set)[A-Za-z0-9_]+\s*\([^)]*\)\s*:\s*return\s+.+$")
PY_ACCESSOR = re.compile(r"(?ms)^\s*@\s*property\b.*|^\s*def\s+(get|set)[A-Za-z0-9_]+\s*\([^)]*\)\s*:\s*(?:\r?\n\s*(?:return\s+|pass\s*$|raise\s+NotImplementedError))?")
BRACED_ACCESSOR = re.compile(r"(?ms)^\s*(public|private|protected)?\s*(static\s+)?[\w<>\[\]]+\s+(get|set)[A-Za-z0-9_]*\s*\([^)]*\)\s*\{\s*(return\s+[^;]+;|this\.[A-Za-z0-9_]+\s*=\s*[A-Za-z0-9_]+;)\s*\}\s*$")
RETURN = re.compile(r"(?ms)^\s*(return\s+[^;]+;|return\s+.+)$")
BRACED = (".java", ".go", ".c", ".cpp", ".h", ".hpp")
CLOSERS = {")": "(", "]": "[", "}": "{"}


class Brackets:
    """What is open after the lines so far. Brackets in quotes do not count, and an open quote by itself leaves nothing open; after a closer that fits no opener nothing counts any more."""

    def __init__(self):
        self.open: list[str] = []
        self.quote, self.escaped, self.broken = "", False, False

    def add(self, line: str) -> None:
        for c in line + "\n":
            if self.broken:
                return
            if self.quote:
                if self.escaped:
                    self.escaped = False
                elif c == "\\":
                    self.escaped = True
                elif c == self.quote:
                    self.quote = ""
            elif c in "'\"":
                self.quote = c
            elif c in "([{":
                self.open.append(c)
            elif c in CLOSERS:
                self.broken = not self.open or self.open.pop() != CLOSERS[c]

    def unbalanced(self) -> bool:
        return bool(self.open) and not self.broken


def unbalanced(text: str) -> bool:
    """Whether a bracket is open at the end of a text."""
    brackets = Brackets()
    brackets.add(text)
    return brackets.unbalanced()


def _continues(line: str) -> bool:
    """A backslash is the very last character, and the line is no comment."""
    return line.endswith("\\") and not line.lstrip().startswith("#")


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" \t"))


def _block_end(lines: list[str], last: int, most: int) -> int:
    """The last line, ``most`` at the furthest, of the block that a colon at the end of line ``last`` opens: deeper lines, blank ones and comments."""
    if not lines[last].rstrip().endswith(":"):
        return last
    depth, end = _indent(lines[last]), last
    for i in range(last + 1, most + 1):
        if lines[i].strip() and not lines[i].lstrip().startswith("#") and _indent(lines[i]) <= depth:
            break
        end = i
    return end


def _window_end(lines: list[str], start: int, last: int, most: int, python: bool) -> int:
    """The last line of a window; whatever made it grow, all is looked at again from the new end."""
    brackets, read = Brackets(), start
    while last < most:
        for i in range(read, last + 1):
            brackets.add(lines[i])
        read = last + 1
        if _continues(lines[last]) or brackets.unbalanced():
            last += 1
        elif python and (end := _block_end(lines, last, most)) > last:
            last = end
        else:
            break
    return last


def low_value(text: str, ext: str) -> bool:
    lines = [x for x in text.splitlines() if x.strip()]
    n, returns = len(lines), RETURN.search(text) is not None
    if not lines or n <= 5 and HEADER.search(text):
        return True
    if ext == ".py":
        return bool(n <= 4 and PY_GETTER.search(text) or n <= 8 and PY_ACCESSOR.search(text) or n <= 3 and returns)
    if ext in BRACED:
        return bool(n <= 7 and BRACED_ACCESSOR.search(text) or n <= 3 and (returns or all(x.strip() in ("{", "}", "};") for x in lines)))
    return False


def chunk(text: str | None, ext: str, target: int = TARGET, overlap: int = OVERLAP, longest: int = LONGEST) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, text), lines from 1 and inclusive."""
    if not text or not text.strip():
        return
    if overlap >= target:
        overlap = max(target // 2, 1) if target > 1 else 0
    lines = text.splitlines()
    start = 0
    while start < len(lines):
        last = min(start + target, len(lines)) - 1
        most = min(start + longest, len(lines)) - 1
        last = _window_end(lines, start, last, most, ext == ".py")
        body = "\n".join(lines[start : last + 1]).strip()
        if body and not low_value(body, ext):
            yield start + 1, last + 1, body
        if last + 1 >= len(lines):
            return
        start = max(last + 1 - overlap, start + 1)


def of_low_value(text: Column, ext: str) -> Column:
    """``low_value`` of a column of texts; null counts as empty."""
    return F.pandas_udf(lambda s: pd.Series([low_value(t or "", ext) for t in s], dtype=bool), "boolean")(text)


class ChunkLines:
    def eval(self, text: str, ext: str):
        yield from chunk(text, ext)


def register(spark: SparkSession) -> None:
    """``chunk_lines(text, ext)`` for LATERAL joins in SQL."""
    spark.udtf.register("chunk_lines", F.udtf(ChunkLines, returnType="start_line int, end_line int, content string"))


def chunked(files: DataFrame) -> DataFrame:
    """(path, start_line, end_line, content) of files with columns path and content; null and blank contents have no chunks."""
    kind = pa.schema([("path", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("content", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 500):
                part = batch.slice(first, 500)
                rows = [(path, *c) for path, ext, text in zip(*(x.to_pylist() for x in part.columns), strict=True) for c in chunk(text, ext)]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(list(zip(*rows, strict=True)) or [[]] * 4, kind, strict=True)], schema=kind)

    ext = F.coalesce(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)), F.lit(""))
    return files.select(F.col("path").cast("string"), ext.alias("ext"), F.col("content").cast("string")).mapInArrow(run, "path string, start_line int, end_line int, content string")
