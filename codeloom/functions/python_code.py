"""Symbols, calls and imports of Python files, from the standard library's syntax trees."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOL = (
    "kind string, name string, full_name string, class_name string, signature string, params array<string>, param_types array<string>, "
    "returns array<string>, bases array<string>, attributes array<string>, docstring string, source string, start_line int, end_line int, "
    "calls array<struct<full_name:string,signature:string>>"
)
_STRINGS, _CALLS = pa.list_(pa.string()), pa.list_(pa.struct([("full_name", pa.string()), ("signature", pa.string())]))
_ARROW = {"array<string>": _STRINGS, "array<struct<full_name:string,signature:string>>": _CALLS, "string": pa.string(), "int": pa.int32()}
# Functions that are no calls of interest.
BUILTINS = frozenset(
    """len str int float bool list dict set tuple print range enumerate zip map filter sorted min max sum any all abs round pow divmod
    isinstance issubclass hasattr getattr setattr delattr id hash type super next iter reversed strip""".split()
)
NO_BASE = frozenset({"object", "ABC", "Protocol"})


def module_of(path: str) -> str:
    parts = path.removesuffix(".py").split("/")
    return ".".join(parts[:-1] if parts[-1] == "__init__" and len(parts) > 1 else parts)


def walked(node: ast.AST) -> list[ast.AST]:
    """The nodes of ``ast.walk``, in its order, without the contexts of names."""
    found = [node]
    for n in found:
        for name in n._fields:
            x = getattr(n, name, None)
            if x.__class__ is list:
                found += [y for y in x if isinstance(y, ast.AST)]
            elif isinstance(x, ast.AST) and not isinstance(x, ast.expr_context):
                found.append(x)
    return found


def statements(tree: ast.Module) -> list[ast.AST]:
    """Statements alone, in the order of ``walked``: enough for imports, as no expression holds one."""
    found: list[ast.AST] = [tree]
    for n in found:
        for name in ("body", "handlers", "orelse", "finalbody", "cases"):
            x = getattr(n, name, None)
            if x.__class__ is list:
                found += x
    return found


def imports(nodes: list[ast.AST], path: str) -> tuple[dict[str, str], list[str]]:
    """(name in the file -> dotted path, dotted paths that it imports, in order). Relative imports that lead out of the tree are left out."""
    package = module_of(path).split(".")
    if not path.endswith("__init__.py"):
        package = package[:-1]
    names: dict[str, str] = {}
    found: dict[str, None] = {}
    for node in nodes:
        if isinstance(node, ast.Import):
            for a in node.names:
                names[a.asname or a.name.partition(".")[0]] = a.name if a.asname else a.name.partition(".")[0]
                found[a.name] = None
        elif isinstance(node, ast.ImportFrom):
            if node.level > len(package) + 1 or node.level > 1 and node.level > len(package):
                continue
            base = package[: len(package) - node.level + 1] if node.level else []
            origin = ".".join([*base, *([node.module] if node.module else [])])
            if origin:
                found[origin] = None
            for a in node.names:
                if a.name != "*":
                    full = f"{origin}.{a.name}" if origin else a.name
                    names[a.asname or a.name] = full
                    found[full] = None
    return names, list(found)


def _dotted(node: ast.AST) -> list[str] | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return [node.id, *parts[::-1]] if isinstance(node, ast.Name) else None


def _kind(arg: ast.AST) -> str:
    return type(arg.value).__name__ if isinstance(arg, ast.Constant) else "Any"


class Reader:
    def __init__(self, tree: ast.Module, path: str):
        self.nodes, self.module = walked(tree), module_of(path)
        self.names, self.imported = imports(self.nodes, path)

    def resolve(self, parts: list[str]) -> str:
        head = self.names.get(parts[0]) or f"{self.module}.{parts[0]}"
        return ".".join([head, *parts[1:]])

    def calls(self, nodes: list[ast.AST], owner: str | None) -> list[tuple[str, str]]:
        found: dict[tuple[str, str], None] = {}
        for call in nodes:
            parts = _dotted(call.func) if isinstance(call, ast.Call) else None
            if not parts or len(parts) == 1 and parts[0] in BUILTINS and parts[0] not in self.names:
                continue
            if parts[0] == "self":
                if not owner or len(parts) < 2:
                    continue
                full = ".".join([self.module, owner, *parts[1:]])
            else:
                full = self.resolve(parts)
            found[full, f"{parts[-1]}({', '.join(map(_kind, call.args))})"] = None
        return list(found)

    def function(self, node: ast.FunctionDef | ast.AsyncFunctionDef, owner: str | None = None) -> tuple:
        a = node.args
        params = [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]
        marks = {id(a.vararg): "*", id(a.kwarg): "**"}
        types = [ast.unparse(p.annotation) if p.annotation else "Any" for p in params]
        returns = {ast.unparse(node.returns)} if node.returns else set()
        nodes = walked(node)
        for x in nodes:
            if isinstance(x, ast.Yield | ast.YieldFrom):
                returns.add("Generator")
            elif isinstance(x, ast.Return) and x.value is not None:
                names = _dotted(x.value.func if isinstance(x.value, ast.Call) else x.value)
                returns.add(_kind(x.value) if isinstance(x.value, ast.Constant) else ".".join(names) if names else "Any")
        result = ast.unparse(node.returns) if node.returns else "Any"
        full = ".".join(x for x in (self.module, owner, node.name) if x)
        return (
            "method" if owner else "function", node.name, full, owner, f"{node.name}({', '.join(types)}) -> {result}",
            [marks.get(id(p), "") + p.arg for p in params], types, sorted(returns), [], [], ast.get_docstring(node), ast.unparse(node),
            node.lineno, node.end_lineno, self.calls(nodes, owner),
        )

    def type_(self, node: ast.ClassDef) -> tuple:
        bases = [p for p in map(_dotted, node.bases) if p]
        attributes = []
        for x in node.body:
            targets = [x.target] if isinstance(x, ast.AnnAssign) else x.targets if isinstance(x, ast.Assign) else []
            attributes += [t.id for t in targets if isinstance(t, ast.Name)]
        kind = "interface" if ["ABC"] in bases else "class"
        own = [self.resolve(p) for p in bases if p[-1] not in NO_BASE]
        return (
            kind, node.name, f"{self.module}.{node.name}", None, node.name, [], [], [], own, attributes, ast.get_docstring(node), ast.unparse(node),
            node.lineno, node.end_lineno, [],
        )

    def symbols(self) -> Iterator[tuple]:
        """Classes wherever they are, each with its methods, and all functions that are no class's own."""
        own = set()
        for node in self.nodes:
            if isinstance(node, ast.ClassDef):
                yield self.type_(node)
                for x in node.body:
                    if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef):
                        own.add(x)
                        yield self.function(x, node.name)
        for node in self.nodes:
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef) and node not in own:
                yield self.function(node)


def parsed(text: str | None) -> ast.Module | None:
    """None for what does not parse."""
    try:
        return ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError):
        return None


def read(text: str | None, path: str) -> Reader | None:
    """None for what does not parse."""
    tree = parsed(text)
    return Reader(tree, path) if tree else None


def arrow_rows(files: DataFrame, rows: Callable[[str, str | None], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that a function makes of each file (path, content), by Arrow batches of a hundred files."""
    fields = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split(" ", 1) for c in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 100):
                found = [r for path, text in zip(*(c.to_pylist() for c in batch.slice(first, 100).columns), strict=True) for r in rows(path, text)]
                columns = list(zip(*found, strict=True)) or [[]] * len(fields)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    return files.select(F.col("path").cast("string"), F.col("content").cast("string")).mapInArrow(run, schema)


def _of_python(files: DataFrame) -> DataFrame:
    return files.where(F.lower("path").endswith(".py"))


def symbols(files: DataFrame) -> DataFrame:
    """(path, symbol columns) of the Python files among (path, content)."""

    def rows(path: str, text: str | None) -> Iterator[tuple]:
        if r := read(text, path):
            for *rest, calls in r.symbols():
                yield (path, *rest, [{"full_name": f, "signature": s} for f, s in calls])

    return arrow_rows(_of_python(files), rows, f"path string, {SYMBOL}")


def files_and_imports(files: DataFrame) -> DataFrame:
    """The rows of ``import_rows`` and, from the same reading, one with nothing but its path for each Python file whose content is not null."""

    def rows(path: str, text: str | None) -> Iterator[tuple]:
        if text is None:
            return
        yield path, None, None, None
        if tree := parsed(text):
            names, imported = imports(statements(tree), path)
            called = {v: k for k, v in names.items()}
            for i, x in enumerate(imported):
                yield path, i, x, called.get(x)

    return arrow_rows(_of_python(files), rows, "path string, pos int, target string, name string")


def import_rows(files: DataFrame) -> DataFrame:
    """(path, pos, target, name): dotted paths that Python files import; ``name`` is what the file calls it, where it gives it a name."""
    return files_and_imports(files).where("target is not null")


def last_name(target: str) -> Column:
    return F.substring_index(target, ".", -1)


def package_of(target: str) -> Column:
    """The dotted path before the last name; empty where there is none."""
    return F.left(F.col(target), F.greatest(F.length(target) - F.length(last_name(target)) - 1, F.lit(0)))


def file_dependencies(files: DataFrame) -> DataFrame:
    """Distinct (src, dst) between Python files: see ``resolved``."""
    from codeloom.sources.scratch import materialize

    both = materialize(files_and_imports(files.select("path", F.coalesce("content", F.lit("")).alias("content"))), "imports")
    imports_ = both.where("target is not null")
    return resolved(imports_, imports_, both.where("target is null"))


def resolved(wanted: DataFrame, imports_: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct (src, dst) for the import rows ``wanted``, among the Python files (path) with all their ``imports_``.

    A dotted path stands for ``a/b.py`` or else ``a/b/__init__.py``. What a package re-exports is
    followed to the file that defines it: only the name that was asked for, or, where the package
    itself was asked for or has no such name, all that it imports. Chains are followed to their end, and
    cycles end by themselves, as files seen before are not followed again.
    """
    from codeloom.sources.scratch import discard, materialize

    path = F.col("path")
    targets = files.select("path").where(F.lower("path").endswith(".py")).select(
        path.alias("dst"),
        F.replace(F.regexp_replace(path, r"(/__init__)?\.py$", ""), F.lit("/"), F.lit(".")).alias("dotted"),
        path.endswith("__init__.py").cast("int").alias("priority"),
    )
    targets = materialize(targets.groupBy("dotted").agg(F.min_by("dst", "priority").alias("dst")), "targets")
    # Each row asks for its dotted path as a whole, and for its last name in the package before.
    package = package_of("target")
    whole = F.struct(F.col("target").alias("dotted"), F.lit(None).cast("string").alias("symbol"))
    asked = wanted.select(path.alias("src"), F.inline(F.array(whole, F.struct(package.alias("dotted"), last_name("target").alias("symbol")))))
    frontier = materialize(asked.where("dotted <> ''").join(targets, "dotted").select("src", "dst", "symbol").where("src <> dst").distinct(), "direct")
    found = frontier.select("src", "dst")
    exports = imports_.where(path.endswith("__init__.py")).select(path.alias("via"), F.col("name").alias("exported"), F.explode(F.array("target", package)).alias("dotted"))
    steps = materialize(exports.where("dotted <> ''").join(targets, "dotted").select("via", F.col("dst").alias("next"), "exported").where("via <> next").distinct(), "exports")
    offered = steps.select(F.col("via").alias("dst"), F.col("exported").alias("symbol")).distinct().withColumn("has", F.lit(True))
    for level in count():
        packages = frontier.where(F.col("dst").endswith("__init__.py"))
        if packages.isEmpty():
            break
        here = packages.join(offered, ["dst", "symbol"], "left")
        more = (
            here.join(steps, here.dst == steps.via)
            .where(F.col("has").isNull() | (F.col("exported") == F.col("symbol")))
            .select("src", F.col("next").alias("dst"), F.when(F.col("has"), F.col("symbol")).alias("symbol"))
            .where("src <> dst").distinct().join(found, ["src", "dst"], "left_anti")
        )
        frontier = materialize(more.select("src", "dst", "symbol"), f"follow{level}")
        found = found.unionByName(frontier.select("src", "dst"))
        if level % 16 == 15:  # so that the plan does not grow with the chain
            found = materialize(found, f"found{level}")
    discard(targets, steps)
    return found.distinct()
