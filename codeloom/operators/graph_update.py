"""The graph of a repository's Python files, kept up to date by what changes.

A change parses the changed files alone. Which other files' dependencies it may touch follows from
the old edges and the imports: those that depended on a changed file, those that import its dotted
path, and those that reach such a package. Only their edges are resolved again and replace the old.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.functions import python_code
from codeloom.functions.text import directory
from codeloom.operators.store import Store
from codeloom.sources.scratch import discard, materialize

TABLES = {"files": "path string", "symbols": f"path string, {python_code.SYMBOL}", "imports": "path string, pos int, target string, name string", "depends": "path string, dst string"}


@dataclass(frozen=True)
class CodeGraph:
    """files (path), symbols and imports by path, and depends (path, dst): edges between files by the one that has the import."""

    files: DataFrame
    symbols: DataFrame
    imports: DataFrame
    depends: DataFrame

    def edges(self) -> DataFrame:
        """(type, src_key, dst_key) of all kinds."""
        own = self.symbols
        member = own.where("class_name is not null").select(F.lit("CONTAINS").alias("type"), F.regexp_replace("full_name", r"\.[^.]+$", "").alias("src_key"), F.col("full_name").alias("dst_key"))
        top = own.where("class_name is null").select(F.lit("CONTAINS").alias("type"), F.col("path").alias("src_key"), F.col("full_name").alias("dst_key"))
        calls = own.select(F.lit("CALLS").alias("type"), F.col("full_name").alias("src_key"), F.explode("calls.full_name").alias("dst_key"))
        bases = own.select(F.lit("INHERITS").alias("type"), F.col("full_name").alias("src_key"), F.explode("bases").alias("dst_key"))
        files = self.depends.select(F.lit("DEPENDS_ON").alias("type"), F.col("path").alias("src_key"), F.col("dst").alias("dst_key"))
        return reduce(DataFrame.union, [member, top, calls, bases, files]).distinct()


@dataclass(frozen=True)
class Delta:
    """What a change puts in the place of what it takes away: of ``changed`` files everything, of ``affected`` ones their edges between files."""

    changed: DataFrame
    affected: DataFrame
    new: CodeGraph


def _dotted(path: Column) -> Column:
    return F.replace(F.regexp_replace(path, r"(/__init__)?\.py$", ""), F.lit("/"), F.lit("."))


def build(files: DataFrame) -> CodeGraph:
    """From (path, content) of all files."""
    both = materialize(python_code.files_and_imports(files), "imports")
    imports, paths = both.where("target is not null"), materialize(both.where("target is null").select("path").distinct(), "files")
    depends = materialize(python_code.resolved(imports, imports, paths).withColumnRenamed("src", "path"), "depends")
    return CodeGraph(paths, python_code.symbols(files), imports, depends)


def affected(graph: CodeGraph, changed: DataFrame) -> DataFrame:
    """The files (path) whose dependencies a change of other files, or of themselves, may touch."""
    dotted = changed.select(_dotted(F.col("path")).alias("target")).distinct()
    asked = graph.imports.select("path", F.explode(F.array("target", python_code.package_of("target"))).alias("target")).where("target <> ''")
    named = asked.join(dotted, "target", "left_semi").select("path").distinct()
    # What passes a changed name on has changed for those that came through it.
    through = named.where(F.col("path").endswith("__init__.py")).unionByName(changed.select("path")).distinct()
    behind = graph.depends.join(through.withColumnRenamed("path", "dst"), "dst", "left_semi").select("path")
    return changed.select("path").unionByName(named).unionByName(behind).distinct()


def delta(graph: CodeGraph, changed: DataFrame) -> Delta:
    """``changed`` has (path, content) of new and changed files, and of deleted ones with null content; other files than Python's are left out, and of rows with one path the greatest content counts."""
    # Many short texts weigh little, but parsing them is work for all cores: a set number of partitions is not coalesced.
    spread = changed.where(F.lower("path").endswith(".py")).repartition(2 * changed.sparkSession.sparkContext.defaultParallelism, "path")
    changed = materialize(spread.groupBy("path").agg(F.max("content").alias("content")), "changed")
    there = changed.where("content is not null")
    own_imports = materialize(python_code.import_rows(there), "imports")
    # Of the old imports only those that are not replaced count, beside the new ones.
    imports = graph.imports.join(changed, "path", "left_anti").unionByName(own_imports)
    files = graph.files.join(changed, "path", "left_anti").unionByName(there.select("path"))
    touched = materialize(affected(CodeGraph(files, graph.symbols, imports, graph.depends), changed), "affected")
    wanted = materialize(imports.join(touched, "path", "left_semi"), "wanted")
    depends = materialize(python_code.resolved(wanted, imports, files).withColumnRenamed("src", "path"), "depends")
    discard(wanted)
    return Delta(changed.select("path"), touched, CodeGraph(there.select("path"), python_code.symbols(there), own_imports, depends))


def update(graph: CodeGraph, changed: DataFrame) -> CodeGraph:
    """The graph after a change."""
    d = delta(graph, changed)
    gone = {"files": d.changed, "symbols": d.changed, "imports": d.changed, "depends": d.affected}
    return CodeGraph(**{t: getattr(graph, t).join(rows, "path", "left_anti").unionByName(getattr(d.new, t)) for t, rows in gone.items()})


def create(store: Store) -> None:
    """Tables of a graph in a store, with a part for each folder."""
    for name, schema in TABLES.items():
        store.create(name, f"folder string, {schema}", "folder")


def stored(store: Store) -> CodeGraph:
    return CodeGraph(**{t: store.read(t).drop("folder") for t in TABLES})


def apply(store: Store, changed: DataFrame) -> Delta:
    """Carry a change out on stored tables: parts of folders without a changed or affected file stay as they are."""
    d = delta(stored(store), changed)
    placed = lambda df: df.withColumn("folder", directory(F.col("path")))
    for t in TABLES:
        store.replace(t, placed(getattr(d.new, t)), ["folder", "path"], placed(d.affected if t == "depends" else d.changed))
    return d


def keep_graph(source: DataFrame, store: Store, checkpoint: str, after: Callable[[Delta], None] = lambda d: None) -> StreamingQuery:
    """Follow a stream of changed files (path, content, null for deleted). A batch that runs again gives the same tables."""

    def step(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            after(apply(store, batch.select("path", "content")))

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
