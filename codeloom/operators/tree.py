"""File trees from paths, in five renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nodes(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, parent, name, depth, is_dir) of every file and folder; paths that start with a dot are left out, a trailing slash means a folder."""
    plain = paths.select(F.trim(F.col(path), F.lit("/")).alias("p"), F.col(path).endswith("/").alias("dir")).where("p <> '' and not p like '.%'")
    parts = F.split("p", "/")
    steps = plain.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("path"), ((i < F.size(parts)) | F.col("dir")).alias("is_dir")))).alias("n"))
    rows = steps.groupBy("n.path").agg(F.max("n.is_dir").alias("is_dir"))
    return rows.select("path", F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("parent"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), (F.size(F.split("path", "/")) - 1).alias("depth"), "is_dir")


def sort_key(tree: DataFrame) -> DataFrame:
    """Add ``key``: orders a tree depth first, folders before files, by name. Each step of a path but the last is a folder."""
    parts = F.split("path", "/")
    step = lambda x, i: F.concat(F.when((i < F.size(parts) - 1) | F.col("is_dir"), F.lit("0")).otherwise(F.lit("1")), x)
    return tree.withColumn("key", F.transform(parts, step))


def listed(tree: DataFrame) -> DataFrame:
    return sort_key(tree).select("key", F.concat("path", F.when(F.col("is_dir"), "/(D)").otherwise("")).alias("line"))


def compact(tree: DataFrame) -> DataFrame:
    return sort_key(tree).select("key", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("name"), F.when(F.col("is_dir"), "/D").otherwise("/F")).alias("line"))


def compressed(tree: DataFrame) -> DataFrame:
    """Paths; folders with one child have no line of their own."""
    children = tree.groupBy(F.col("parent").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    kept = tree.join(children, "path", "left").where("not is_dir or coalesce(n, 0) <> 1")
    return sort_key(kept).select("key", F.concat("path", F.when(F.col("is_dir"), "/").otherwise("")).alias("line"))


def unix(tree: DataFrame) -> DataFrame:
    """With branches: whether a node and each folder above it is the last of its siblings decides what stands before it."""
    keyed = sort_key(tree)
    last = keyed.withColumn("last", F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("key"))) == 1)
    above = last.select(F.explode(F.transform(F.sequence(F.lit(1), F.col("depth") + 1), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/"))).alias("up"), "path")
    flags = last.select(F.col("path").alias("up"), F.col("last").alias("up_last"), F.col("depth").alias("up_depth"))
    grouped = above.join(flags, "up").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("up_depth", "up_last"))).alias("flags"))
    before = F.array_join(F.transform(F.slice("flags", 1, F.size("flags") - 1), lambda f: F.when(f["up_last"], "    ").otherwise("│   ")), "")
    own = F.when(F.col("last"), "└── ").otherwise("├── ")
    return last.join(grouped, "path").select("key", F.concat(before, own, "name", F.when(F.col("is_dir"), "/").otherwise("")).alias("line"))


def rendered(lines: DataFrame, head: str = "") -> str:
    """All lines in order as one text, for a tree that a person reads."""
    return "\n".join(([head] if head else []) + [r.line for r in lines.orderBy("key").select("line").toLocalIterator()])


def as_json(tree: DataFrame) -> dict:
    """{"folder": {"file": "F"}}, for a tree that a person reads."""
    out: dict = {}
    for r in sort_key(tree).orderBy("key").select("path", "is_dir").toLocalIterator():
        *folders, name = r.path.split("/")
        at = out
        for f in folders:
            at = at.setdefault(f, {})
        at.setdefault(name, {} if r.is_dir else "F")
    return out


def catalogue(paths: Column) -> Column:
    """Aggregate: all paths in order, a line each."""
    return F.array_join(F.array_sort(F.collect_list(paths)), "\n")
