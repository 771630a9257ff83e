"""A data source over the entries of archives: zip, tar (plain or compressed) and single gzip files.

The driver reads the directories of the archives, and partitions are groups of entries: tasks read
theirs by their place in the file. Compressed tar and gzip files can only be read from their start,
so each of them is one partition, which is read as a stream. Archives in a store that only Spark
reaches are expanded from its binary files by ``expanded``.
"""

from __future__ import annotations

import gzip
import io
import os
import re
import tarfile
import zipfile
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, path string, size long, part int, content binary"
#: Extensions by kind.
KINDS = {".zip": "zip", ".tar": "tar", ".tar.gz": "tar.gz", ".tgz": "tar.gz", ".tar.bz2": "tar.gz", ".tar.xz": "tar.gz", ".gz": "gz"}


def kind_of(name: str) -> str:
    found = [k for ext, k in sorted(KINDS.items(), key=lambda x: -len(x[0])) if name.lower().endswith(ext)]
    if not found:
        raise ValueError(f"{name} is no archive of a known kind")
    return found[0]


def safe(name: str) -> str:
    """The path of an entry, slashes forward; an error where it would lead out of the archive's folder."""
    path = name.replace("\\", "/")
    if path.startswith("/") or re.match(r"[A-Za-z]:", path) or ".." in path.split("/") or "\0" in path:
        raise ValueError(f"an entry that leads out of its archive: {name!r}")
    return "/".join(p for p in path.split("/") if p not in ("", "."))


def root_of(paths: list[str]) -> str:
    """The one folder that all entries lie in, with its slash, or nothing."""
    tops = {p.split("/")[0] for p in paths}
    return tops.pop() + "/" if len(tops) == 1 and all("/" in p for p in paths) else ""


def listed(file: BinaryIO, name: str) -> list[tuple[str, int, object]]:
    """(entry's path without a root that all share, size, where it is) of all files in an archive, in order; of entries with one name the last counts. Links and devices are left out."""
    kind = kind_of(name)
    if kind == "gz":
        return [(re.sub(r"(?i)\.gz$", "", os.path.basename(name)), -1, None)]
    if kind == "zip":
        with zipfile.ZipFile(file) as z:
            found = [(safe(i.filename), i.file_size, i.filename) for i in z.infolist() if not i.is_dir() and (i.external_attr >> 28) != 0xA]
    else:
        with tarfile.open(fileobj=file, mode="r:" if kind == "tar" else "r:*") as t:
            found = [(safe(m.name), m.size, m.offset_data) for m in t if m.isreg()]
    root = root_of([p for p, _, _ in found])
    return list({p: (p.removeprefix(root), size, at) for p, size, at in found}.values())


def pieces(stream: BinaryIO, most: int) -> Iterator[tuple[int, bytes]]:
    """(number, bytes) of a stream, ``most`` at once; one empty piece for an empty stream."""
    part, data = 0, stream.read(most)
    while data or not part:
        yield part, data
        part, data = part + 1, stream.read(most)


def read(file: BinaryIO, name: str, wanted: list[tuple[str, int, object]], most: int) -> Iterator[tuple[str, int, int, bytes]]:
    """(path, size, part, content) of some entries."""
    kind = kind_of(name)
    if kind == "zip":
        with zipfile.ZipFile(file) as z:
            for path, size, at in wanted:
                with z.open(at) as stream:
                    yield from ((path, size, k, data) for k, data in pieces(stream, most))
    elif kind == "tar":
        for path, size, at in wanted:
            for k in range(max(1, -(-size // most))):
                file.seek(at + k * most)
                yield path, size, k, file.read(min(most, size - k * most))
    elif kind == "gz":
        with gzip.open(file) as stream:
            yield from ((wanted[0][0], -1, k, data) for k, data in pieces(stream, most))
    else:
        places = {at: (path, size) for path, size, at in wanted}
        with tarfile.open(fileobj=file, mode="r|*") as t:
            for m in t:
                if m.isreg() and m.offset_data in places:
                    path, size = places[m.offset_data]
                    yield from ((path, size, k, data) for k, data in pieces(t.extractfile(m), most))


class Part(InputPartition):
    def __init__(self, archive: str, entries: list):
        self.archive, self.entries = archive, entries


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.most = int(options.get("part_bytes", 16 << 20))
        self.in_partition = int(options.get("partition_bytes", 64 << 20))

    def partitions(self):
        if os.path.isdir(self.root):
            names = sorted(n for n in os.listdir(self.root) if any(n.lower().endswith(e) for e in KINDS))
        else:
            names = [""]
        out = []
        for name in names:
            path = os.path.join(self.root, name) if name else self.root
            with open(path, "rb") as file:
                entries = listed(file, path)
            if kind_of(path) in ("gz", "tar.gz"):
                out.append(Part(path, entries))
                continue
            group, size = [], 0
            for entry in entries:
                if group and size + entry[1] > self.in_partition:
                    out.append(Part(path, group))
                    group, size = [], 0
                group.append(entry)
                size += entry[1]
            out += [Part(path, group)] if group else []
        return out or [Part("", [])]

    def read(self, partition):
        if partition.entries:
            with open(partition.archive, "rb") as file:
                for row in read(file, partition.archive, partition.entries, self.most):
                    yield (os.path.basename(partition.archive), *row)


class Archives(DataSource):
    """Option ``path`` is an archive or a folder of archives; ``part_bytes`` (16 MB) the size beyond which an entry comes in several rows, numbered by ``part``; ``partition_bytes`` (64 MB) what a task reads.

    The size is -1 where it is only known at the end. Empty archives have no rows. An entry whose
    path leads out of the archive is an error, and so is an archive of another kind.
    """

    @classmethod
    def name(cls):
        return "archives"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ArchiveReader(self.options)


def archive_files(spark: SparkSession, path: str, **options: int) -> DataFrame:
    spark.dataSource.register(Archives)
    return spark.read.format("archives").options(path=path, **options).load()


def expanded(archives: DataFrame, most: int = 16 << 20) -> DataFrame:
    """The same rows from archives as Spark's binaryFile source reads them (path, content): an archive is one task's work and fits its memory."""
    kind = pa.schema([("archive", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("part", pa.int32()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_buffer().to_pybytes()
                name = os.path.basename(path)
                for row in read(io.BytesIO(data), name, listed(io.BytesIO(data), name), most):
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((name, *row), kind, strict=True)], schema=kind)

    return archives.select("path", "content").mapInArrow(run, SCHEMA)


def source_files(entries: DataFrame, extensions: list[str], most: int = 8 << 20) -> DataFrame:
    """(archive, path, content) of text files by extension, as UTF-8 without what is none; entries in several parts, or over ``most`` bytes, are left out as no source files."""
    wanted = F.lower("path").rlike("(" + "|".join(re.escape(e) for e in extensions) + ")$")
    whole = entries.where(wanted & (F.col("size") <= most) & (F.octet_length("content") == F.col("size")))
    return whole.select("archive", "path", F.regexp_replace(F.decode("content", "UTF-8"), "\ufffd", "").alias("content"))
