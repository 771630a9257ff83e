"""Tables with upsert, update and delete on plain parquet.

A table's rows lie in parts, one for each value of its scope column (such as a repository). A version
is a small file that names the folder of every part. A change writes new folders for the parts that
it touches, and then a version that names these and all other parts as they were. The next version
number can be taken only once; whoever comes second looks at what came first, and either adds its
parts to it or, where that touched the same ones, starts again. Readers never see half a change.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from time import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codeloom.operators.search import condition

# Fixed value: what is blanked in strings that are set.
QUOTES = r"(['\n\r]|\\.)"


def failed(new: DataFrame, keys: list[str]) -> DataFrame:
    """The records that cannot be stored, as a part of their key is null."""
    return new.where(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys]))


def upsert(current: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """New rows replace current ones with the same keys; the rest stays.

    Of new rows with the same keys one counts: the one with the greatest ``order``, a column, and of
    those the one whose values have the greatest hash. Rows that ``failed`` names are left out.
    """
    plain = [F.col(c) for c, kind in new.dtypes if "map<" not in kind]
    last = F.max_by(F.struct(*new.columns), F.struct(*([F.col(order)] if order else []), F.xxhash64(*plain))).alias("v")
    one = new.dropna(subset=keys).groupBy(*keys).agg(last).select("v.*")
    return current.join(one.select(*keys), keys, "left_anti").unionByName(one, allowMissingColumns=True)


def replace_scope(current: DataFrame, new: DataFrame, scope: list[str], done: DataFrame | None = None) -> DataFrame:
    """All rows of every scope (such as a file) that ``new`` or ``done`` names go, then the new rows come: an empty result clears its scope."""
    scopes = new.select(*scope).distinct()
    scopes = scopes if done is None else scopes.union(done.select(*scope)).distinct()
    return current.join(scopes, scope, "left_anti").unionByName(new, allowMissingColumns=True)


def scrub(value: Column) -> Column:
    """Quotes, line ends and backslash escapes become blanks."""
    return F.regexp_replace(value, QUOTES, " ")


def remove_first(values: Column, value) -> Column:
    at = F.array_position(values, value).cast("int")
    cut = F.concat(F.slice(values, F.lit(1), at - 1), F.slice(values, at + 1, F.greatest(F.size(values) - at, F.lit(0))))
    return F.when(at > 0, cut).otherwise(values)


def update(df: DataFrame, wanted: dict, new: dict) -> DataFrame:
    """Change the rows that meet a condition.

    ``remove`` takes a field to clear, or {array: value} to drop its first occurrence; ``add`` takes
    {array: value} to append. Other keys set a field; strings are scrubbed and lists become JSON.
    Values that are false are ignored, except of ``available_int``.
    """
    hit = F.coalesce(condition(df, wanted), F.lit(False))
    kinds, out = dict(df.dtypes), {}
    for name, value in new.items():
        if name == "remove":
            for f, v in value.items() if isinstance(value, dict) else [(value, None)]:
                out[f] = F.when(hit, F.lit(None).cast(kinds[f]) if v is None else remove_first(F.col(f), v)).otherwise(F.col(f))
        elif name == "add":
            for f, v in value.items():
                out[f] = F.when(hit, F.array_append(F.coalesce(F.col(f), F.array().cast(kinds[f])), v.strip() if isinstance(v, str) else v)).otherwise(F.col(f))
        elif value or name == "available_int":
            c = scrub(F.lit(value)) if isinstance(value, str) else F.to_json(F.array(*map(F.lit, value))) if isinstance(value, list) else F.lit(value)
            out[name] = F.when(hit, c.cast(kinds[name])).otherwise(F.col(name))
    return df.withColumns(out)


def delete(df: DataFrame, wanted: dict) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows that go). A condition that would match everything is an error."""
    if not any(v or k == "available_int" for k, v in wanted.items()):
        raise ValueError("a condition that matches every row")
    hit = F.coalesce(condition(df, wanted), F.lit(False))
    return df.where(~hit), df.where(hit)


def delete_in_spaces(spaces: dict[str, DataFrame], wanted: dict) -> tuple[dict[str, DataFrame], DataFrame]:
    """(what stays of each space, one row with the number that goes from all of them)."""
    parts = {name: delete(df, wanted) for name, df in spaces.items()}
    gone = reduce(DataFrame.unionByName, [go.select(F.lit(1).alias("one")) for _, go in parts.values()])
    return {name: stay for name, (stay, _) in parts.items()}, gone.agg(F.count(F.lit(1)).alias("deleted"))


#: The column that tells parts apart, as folder names do.
PART = "__part"


def part_of(value) -> str:
    """The part that holds a value of the scope column."""
    return "none" if value is None else hashlib.sha1(str(value).encode()).hexdigest()


@dataclass(frozen=True)
class Version:
    """A table as one version has it: the folders by part, under one schema."""

    spark: SparkSession
    number: int
    scope: str | None
    schema: StructType
    parts: dict[str, str]

    def rows(self, parts: Iterable[str] | None = None) -> DataFrame:
        """All rows, or those of some parts; no other folder is read."""
        own = [self.parts[p] for p in (self.parts if parts is None else dict.fromkeys(parts)) if p in self.parts]
        return self.spark.read.schema(self.schema).parquet(*own) if own else self.spark.createDataFrame([], self.schema)

    def touched(self, rows: DataFrame) -> set[str]:
        """The parts of rows: as many values as a change has scopes reach the driver."""
        return {part_of(r[0]) for r in rows.select(F.col(self.scope).cast("string")).distinct().collect()} if self.scope else {"none"}


@dataclass
class Change:
    """New rows for the parts that a change touches. ``reads`` are the parts that it depends on, None if on all."""

    touches: set[str]
    rows: DataFrame
    reads: set[str] | None


class Store:
    """Tables under one folder of a file system that Spark writes to and whose rename does not replace files.

    ``scope`` is the column whose values get a part each, ``repo_id`` where there is one. Old versions
    stay readable until ``clean`` removes them.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _files(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _numbers(self, name: str) -> list[int]:
        fs, p = self._files(f"{self.root}/{name}.versions")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()) if fs.exists(p) else []

    def exists(self, name: str) -> bool:
        return bool(self._numbers(name))

    def version(self, name: str, number: int | None = None) -> Version:
        """The current version, or an earlier one."""
        numbers = self._numbers(name)
        if not numbers or number not in (None, *numbers):
            raise LookupError(f"no table {name}" if not numbers else f"no version {number} of {name}")
        number = numbers[-1] if number is None else number
        fs, p = self._files(f"{self.root}/{name}.versions/{number:012d}")
        stream = fs.open(p)
        try:
            about = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(self.spark, number, about["scope"], StructType.fromJson(about["schema"]), about["parts"])

    def _publish(self, name: str, version: Version) -> bool:
        """Take a version number; False if it is taken. The file is complete before it gets its name."""
        fs, own = self._files(f"{self.root}/{name}.versions/new-{uuid.uuid4().hex}")
        out = fs.create(own, False)
        out.writeBytes(json.dumps({"scope": version.scope, "schema": version.schema.jsonValue(), "parts": version.parts}))
        out.close()
        _, to = self._files(f"{self.root}/{name}.versions/{version.number:012d}")
        if fs.getScheme() != "file":
            done = not fs.exists(to) and fs.rename(own, to)
        else:  # on a local disk a rename would replace the file, but a link does not
            try:
                os.link(own.toUri().getPath(), to.toUri().getPath())
                done = True
            except FileExistsError:
                done = False
        fs.delete(own, False)
        return done

    def _write_parts(self, name: str, rows: DataFrame, scope: str | None) -> tuple[str, dict[str, str]]:
        """Large parts are written by several tasks, small ones share one."""
        folder = f"{self.root}/{name}.data/{uuid.uuid4().hex}"
        part = F.coalesce(F.sha1(F.col(scope).cast("string")), F.lit("none")) if scope else F.lit("none")
        rows.withColumn(PART, part).hint("rebalance", PART).write.partitionBy(PART).parquet(folder)
        fs, p = self._files(folder)
        names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
        return folder, {n.partition("=")[2]: f"{folder}/{n}" for n in names}

    def change(self, name: str, plan: Callable[[Version], Change | None]) -> None:
        """Carry out what ``plan`` makes of the current version; it is asked again where another change came between that it depends on."""
        while True:
            base = self.version(name)
            step = plan(base)
            if step is None:
                return
            folder, new = self._write_parts(name, step.rows, base.scope)
            latest = base
            while latest.number == base.number or (step.reads is not None and all(latest.parts.get(p) == base.parts.get(p) for p in step.reads | step.touches)):
                parts = {p: f for p, f in latest.parts.items() if p not in step.touches} | new
                known = set(latest.schema.names)
                schema = StructType([*latest.schema.fields, *[f for f in step.rows.schema.fields if f.name not in known]])
                if self._publish(name, Version(self.spark, latest.number + 1, base.scope, schema, parts)):
                    return
                latest = self.version(name)
            fs, p = self._files(folder)
            fs.delete(p, True)

    def create(self, name: str, schema: str | StructType, scope: str | None = None) -> bool:
        """Does nothing where the table exists."""
        if not self.exists(name):
            kind = self.spark.createDataFrame([], schema).schema
            scope = scope or ("repo_id" if "repo_id" in kind.names else None)
            self._publish(name, Version(self.spark, 0, scope, kind, {}))
        return True

    def drop(self, name: str) -> bool:
        """A missing table is dropped already."""
        for end in ("versions", "data"):
            fs, p = self._files(f"{self.root}/{name}.{end}")
            fs.delete(p, True)
        return True

    def clean(self, name: str, keep: int = 2, age: float = 3600) -> int:
        """Remove all but the last ``keep`` versions and the folders that only these used; how many folders went.

        Folders written in the last ``age`` seconds stay, as a change under way may be about to name them.
        """
        numbers = self._numbers(name)
        used = {f.rpartition("/")[0].rpartition("/")[2] for n in numbers[-keep:] for f in self.version(name, n).parts.values()}
        for n in numbers[:-keep]:
            fs, p = self._files(f"{self.root}/{name}.versions/{n:012d}")
            fs.delete(p, False)
        fs, p = self._files(f"{self.root}/{name}.data")
        gone = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName() not in used and s.getModificationTime() < (time() - age) * 1000] if fs.exists(p) else []
        for path in gone:
            fs.delete(path, True)
        return len(gone)

    def read(self, name: str, scopes: Iterable | None = None) -> DataFrame:
        """All rows, or those with some values of the scope column."""
        version = self.version(name)
        return version.rows(None if scopes is None else map(part_of, scopes))

    def write(self, name: str, df: DataFrame, scope: str | None = None) -> None:
        """Replace the whole table; a missing one is created."""
        if not self.exists(name):
            self.create(name, df.schema, scope)
        self.change(name, lambda base: Change({*base.parts}, df, None))

    def replace(self, name: str, new: DataFrame, scope: list[str], done: DataFrame | None = None) -> None:
        """``replace_scope`` on a table: only parts that the scopes lie in are read and written."""
        scopes = new.select(*scope) if done is None else new.select(*scope).union(done.select(*scope))

        def plan(base: Version) -> Change | None:
            own = base.touched(scopes) if base.scope in (None, *scope) else base.touched(base.rows().join(scopes.distinct(), scope, "left_semi")) | base.touched(new)
            rows = replace_scope(base.rows(own), new, scope, done)
            return Change(own, rows, own if base.scope in (None, *scope) else None)

        self.change(name, plan)

    def upsert(self, name: str, new: DataFrame, keys: list[str]) -> None:
        """Keys that hold the scope column need no look at other parts."""

        def plan(base: Version) -> Change:
            own = base.touched(new.dropna(subset=keys))
            within = base.scope in (None, *keys)
            if not within:
                own |= base.touched(base.rows().join(new.select(*keys).distinct(), keys, "left_semi"))
            return Change(own, upsert(base.rows(own), new, keys), own if within else None)

        self.change(name, plan)

    def _hit(self, base: Version, wanted: dict) -> tuple[set[str], set[str] | None]:
        """(parts with rows that meet a condition, parts that this depends on)."""
        value = wanted.get(base.scope) if base.scope else None
        own = {part_of(v) for v in (value if isinstance(value, list | tuple) else [value])} if value else None
        rows = base.rows(own)
        return base.touched(rows.where(F.coalesce(condition(rows, wanted), F.lit(False)))) if base.scope else {"none"}, own

    def update(self, name: str, wanted: dict, new: dict) -> None:
        def plan(base: Version) -> Change | None:
            own, reads = self._hit(base, wanted)
            return Change(own, update(base.rows(own), wanted, new), reads) if own else None

        if self.version(name).scope in new:
            raise ValueError("the scope column tells where rows lie and cannot be set")
        self.change(name, plan)

    def update_by_id(self, name: str, id_: str, new: dict, id_field: str = "id") -> None:
        self.update(name, {id_field: id_}, new)

    def delete(self, name: str, wanted: dict) -> int:
        n = 0

        def plan(base: Version) -> Change | None:
            nonlocal n
            delete(base.rows(()), wanted)  # an error before anything is read, if all rows would go
            own, reads = self._hit(base, wanted)
            stay, go = delete(base.rows(own), wanted)
            n = go.count() if own else 0
            return Change(own, stay, reads) if n else None

        self.change(name, plan)
        return n

    def get(self, names: list[str], id_: str, id_field: str = "id") -> dict | None:
        """One record by id; None unless exactly one table is named and has it."""
        row = self.read(names[0]).where(F.col(id_field) == id_).first() if len(names) == 1 else None
        return row.asDict(recursive=True) if row else None
