"""A data source over the files of a source-code repository.

Spark's own file sources skip names that start with ``_`` or ``.``, such as ``__init__.py``. Here the
driver lists the folder, or the part of it that is asked for, and executors read the files.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import BinaryIO

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codeloom.schema import EXCLUDED_DIRS, LANGUAGES

READMES = ("README.md", "README.rst", "README.txt", "README")


def resolve_target(root: str, target: str | None) -> tuple[bool, str]:
    """(is a directory, path without outer slashes). A path that does not exist and is not written as a directory is an error."""
    path = (target or "").replace("\\", "/")
    as_dir, path = path.endswith("/"), path.strip("/")
    full = os.path.join(root, path)
    if os.path.isdir(full) or as_dir or not path:
        return True, path
    if not os.path.exists(full):
        raise FileNotFoundError(path)
    return False, path


def walk(root: str, target: str | None = None, extensions: tuple[str, ...] = tuple(LANGUAGES)) -> Iterator[str]:
    """Relative paths of source files in order, without hidden and excluded directories."""
    is_dir, path = resolve_target(root, target)
    if not is_dir:
        yield path
        return
    for folder, dirs, names in os.walk(os.path.join(root, path)):
        dirs[:] = sorted(d for d in dirs if not d.startswith(".") and d not in EXCLUDED_DIRS)
        for name in sorted(names):
            if os.path.splitext(name)[1].lower() in extensions:
                yield os.path.relpath(os.path.join(folder, name), root).replace(os.sep, "/")


class Part(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class RepoFilesReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["root"]
        self.target = options.get("target")
        self.extensions = tuple(options["extensions"].split(",")) if options.get("extensions") else tuple(LANGUAGES)
        self.in_part = int(options.get("files_in_partition", "200"))

    def partitions(self):
        paths = list(walk(self.root, self.target, self.extensions))
        return [Part(paths[i : i + self.in_part]) for i in range(0, len(paths), self.in_part)] or [Part([])]

    def read(self, partition):
        for path in partition.paths:
            full = os.path.join(self.root, path)
            try:
                stat = os.stat(full)
                with open(full, "rb") as f:
                    content = f.read().decode("utf-8", "ignore")
            except OSError:
                continue  # it went away since it was listed
            yield path, datetime.fromtimestamp(stat.st_mtime, UTC), stat.st_size, content


class RepoFiles(DataSource):
    @classmethod
    def name(cls):
        return "repo_files"

    def schema(self):
        return "path string, mtime timestamp, size long, content string"

    def reader(self, schema):
        return RepoFilesReader(self.options)


def fields(stream: BinaryIO, n: int, at_once: int = 1 << 16) -> Iterator[list[str]]:
    """Rows of ``n`` texts, each of which ends with a zero byte (the last one may not), from a stream that is read as it comes."""
    row, rest = [], b""
    while data := stream.read(at_once):
        *done, rest = (rest + data).split(b"\0")
        for value in done:
            row.append(value.decode("utf-8", "replace"))
            if len(row) == n:
                yield row
                row = []
    if row:
        yield [*row, rest.decode("utf-8", "replace")]


class GitLogReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.since, self.path = options["root"], options.get("since"), options.get("path")

    def read(self, partition):
        span = [f"{self.since}..HEAD"] if self.since else ["HEAD"]
        command = ["git", "-C", self.root, "log", "-z", "--format=%H%x00%an%x00%ae%x00%s%x00%ct", *span, *(["--", self.path] if self.path else [])]
        with subprocess.Popen(command, stdout=subprocess.PIPE) as log:
            yield from map(self._commit, fields(log.stdout, 5))
        if log.returncode:
            raise RuntimeError(f"git log failed in {self.root}")

    @staticmethod
    def _commit(values: list[str]) -> tuple:
        *texts, when = values
        return *texts, datetime.fromtimestamp(int(when), UTC)


class GitLog(DataSource):
    """Commits: all, those after ``since``, or those that touch ``path``."""

    @classmethod
    def name(cls):
        return "git_log"

    def schema(self):
        return "sha string, author string, email string, message string, committed_at timestamp"

    def reader(self, schema):
        return GitLogReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (RepoFiles, GitLog):
        spark.dataSource.register(source)


def repo_files(spark: SparkSession, root: str, **options: str):
    register(spark)
    return spark.read.format("repo_files").options(root=root, **options).load()


def ignore_patterns(root: str) -> list[str]:
    """The lines of the root's ignore file that are no comments; none where there is no such file."""
    path = os.path.join(root, ".gitignore")
    if not os.path.isfile(path):
        return []
    with open(path, encoding="utf-8", errors="ignore") as f:
        return [x.strip() for x in f if x.strip() and not x.startswith("#")]


def catalogue(spark: SparkSession, root: str, **options: str):
    """(path, is_dir) of the files of a repository and the folders above them, without what its ignore file names: by base names, and with a folder goes all in it."""
    from codeloom.functions.text import ignored

    files = repo_files(spark, root, **options).select("path")
    parts = F.split("path", "/")
    each = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("path"), (i < F.size(parts)).alias("is_dir"), F.element_at(parts, i).alias("name")))
    patterns = ignore_patterns(root)
    kept = files.withColumn("each", each).where(~F.exists("each", lambda e: ignored(e["name"], e["is_dir"], patterns)))
    return kept.select(F.explode("each").alias("e")).select("e.path", "e.is_dir").distinct()


def readme(root: str) -> str | None:
    """The text of the first README that there is."""
    path = next((p for n in READMES if os.path.isfile(p := os.path.join(root, n))), None)
    return open(path, encoding="utf-8", errors="ignore").read() if path else None
