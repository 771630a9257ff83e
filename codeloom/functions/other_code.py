"""Imports of Java, Go, JavaScript, C and C++ files, and the files that they stand for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import braces

# How imports are written.
IMPORTS = {
    "java": [r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;"],
    "go": [r"(?m)^\s*import\s+(?:[\w.]+\s+)?\"([^\"]+)\"", r"(?m)^\s*(?:[\w.]+\s+)?\"([\w./-]+)\"\s*$"],
    "javascript": [r"import\s+[^'\"()]*?from\s*['\"]([^'\"]+)['\"]", r"import\s*['\"]([^'\"]+)['\"]", r"require\(\s*['\"]([^'\"]+)['\"]\s*\)", r"import\(\s*['\"]([^'\"]+)['\"]\s*\)"],
    "c": [r"(?m)^\s*#\s*include\s*\"([^\"]+)\""],
}
IMPORTS["cpp"] = IMPORTS["c"]


#: The module of a Java file: what comes before its source folder.
ROOT = r"^(?:.*?(?=src/))?"


def imported(text: Column, language: str) -> Column:
    """Array of the distinct imports in a file, in order of the patterns."""
    found = reduce(lambda a, b: F.concat(a, b), [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in IMPORTS[language]])
    return F.filter(F.array_distinct(found), lambda x: ~x.startswith("node:"))


def declarations(files: DataFrame, language: str) -> DataFrame:
    """(path, kind, name) of files in one language: their classes, methods and functions."""
    return braces.arrow_rows(files, lambda path, text: ((path, s.kind, s.name) for s in braces.read(text, language)), "path string, kind string, name string")


def go_fields(body: Column) -> Column:
    """``name:type`` of each field in the body of a struct."""
    lines = F.filter(F.transform(F.split(body, "[\n;]"), lambda s: F.trim(s)), lambda s: s.rlike(r"^\w+\s+\S"))
    return F.transform(lines, lambda s: F.regexp_replace(s, r"^(\w+)\s+(\S+).*$", "$1:$2"))


def _candidates(files: DataFrame, language: str, module: str | None) -> DataFrame:
    """(src, target, priority, candidate path or folder, is_dir)."""
    own = files.select(F.col("path").alias("src"), F.explode(imported(F.col("content"), language)).alias("target"))
    folder = F.regexp_extract("src", r"^(.*)/[^/]+$", 1)
    joined = F.when(folder == "", F.col("target")).otherwise(F.concat(folder, F.lit("/"), F.col("target")))
    if language in ("c", "cpp"):
        options = [joined, F.col("target")]
    elif language == "javascript":
        own = own.where(F.col("target").startswith(".") | F.col("target").startswith("/"))
        options = [F.concat(joined, F.lit(e)) for e in ("", ".js", ".jsx", ".mjs", ".cjs", "/index.js", "/index.jsx", "/index.mjs", "/index.cjs")]
    elif language == "java":
        path = F.replace(F.col("target"), F.lit("."), F.lit("/"))
        up = F.regexp_extract(path, r"^(.*)/[^/]+$", 1)
        options = [F.concat(path, F.lit(".java")), F.concat(up, F.lit(".java")), F.concat(F.regexp_extract(up, r"^(.*)/[^/]+$", 1), F.lit(".java")), F.when(F.col("target").endswith(".*"), up)]
    else:
        own = own.where(F.col("target").startswith(module or "\0"))
        options = [F.ltrim(F.substr("target", F.lit(len(module or "") + 1)), F.lit("/"))]
    listed = F.array(*[F.struct(F.lit(i).alias("priority"), o.alias("candidate")) for i, o in enumerate(options)])
    return own.select("src", "target", F.explode(listed).alias("o")).select("src", "target", "o.*").where("candidate is not null and candidate <> ''")


def file_dependencies(files: DataFrame, language: str, module: str | None = None) -> DataFrame:
    """Distinct (src, dst): the first candidate of each import that exists.

    A Go package and a Java wildcard stand for all files right in their folder. ``module`` is the
    module path of go.mod. Java sources may lie under any root: of files with the same path under
    theirs those under the importing file's own root count, or, where it has none, the first by path
    (of a wildcard, all).
    """
    from codeloom.functions.text import directory, fold_path

    wanted = _candidates(files, language, module).withColumn("candidate", fold_path(F.col("candidate")))
    paths = files.select(F.col("path").alias("dst"), directory(F.col("path")).alias("folder"))
    if language == "java":
        root = F.regexp_extract("path", ROOT, 0)
        bare = F.regexp_replace("path", r"^.*?src/(?:main/|test/)?(?:java/)?", "")
        paths = files.select(F.col("path").alias("dst"), bare.alias("bare"), directory(bare).alias("folder"), root.alias("root"))
    exact = paths.withColumn("candidate", F.col("bare" if language == "java" else "dst"))
    if language == "go":
        hits = wanted.join(paths, wanted.candidate == paths.folder).where(~F.col("dst").endswith("_test.go"))
        return hits.where("src <> dst").select("src", "dst").distinct()
    if language != "java":
        first = wanted.join(exact, "candidate").groupBy("src", "target").agg(F.min_by("dst", "priority").alias("dst"))
        return first.where("src <> dst").select("src", "dst").distinct()
    elsewhere = (F.col("root") != F.regexp_extract("src", ROOT, 0)).cast("int").alias("elsewhere")
    hits = wanted.join(exact, "candidate").select("src", "target", "dst", "priority", elsewhere)
    first = hits.groupBy("src", "target").agg(F.min_by("dst", F.struct("priority", "elsewhere", "dst")).alias("dst")).select("src", "dst")
    star = wanted.where("target like '%.*'").join(paths, wanted.candidate == paths.folder).select("src", "target", "dst", elsewhere)
    nearest = star.groupBy("src", "target").agg(F.min("elsewhere").alias("elsewhere"))
    star = star.join(nearest, ["src", "target", "elsewhere"]).select("src", "dst")
    return first.unionByName(star).where("src <> dst").distinct()
