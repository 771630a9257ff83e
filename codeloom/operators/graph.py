"""The property graph as two tables, nodes and edges: building, queries, deletes."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.sources.scratch import materialize

EDGE = ["repo_id", "type", "src_label", "src_key", "dst_label", "dst_key"]
NODE = ["repo_id", "label", "key"]


def upsert_nodes(current: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each identity: the new values win, the first created_at stays."""
    both = current.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in current.columns if c not in (*NODE, "created_at")]
    last = both.groupBy(*NODE).agg(F.max_by(F.struct(*rest), F.struct("__new", "updated_at")).alias("v"), F.min("created_at").alias("created_at"))
    return last.select(*NODE, *[F.col(f"v.{c}").alias(c) for c in rest], "created_at").select(*current.columns)


def upsert_edges(current: DataFrame, new: DataFrame) -> DataFrame:
    return current.unionByName(new).groupBy(*EDGE).agg(F.max("updated_at").alias("updated_at"))


def stub_endpoints(nodes: DataFrame, edges: DataFrame, label: str, node_type: str) -> DataFrame:
    """Nodes for edge targets that no node stands for yet."""
    ends = edges.where(F.col("dst_label") == label).select("repo_id", F.col("dst_label").alias("label"), F.col("dst_key").alias("key")).distinct()
    return ends.join(nodes, NODE, "left_anti").withColumns({"name": F.element_at(F.split("key", r"\."), -1), "full_name": F.col("key"), "node_type": F.lit(node_type)})


def called(nodes: DataFrame, calls: DataFrame, now: Column) -> DataFrame:
    """Nodes after calls (repo_id, dst_key, name, signature) are saved: a function that is called has the name and signature that the call has, and one that is not there comes in as of type ``api``.

    Of several calls of a function that with the greatest signature counts.
    """
    last = calls.groupBy("repo_id", F.col("dst_key").alias("key")).agg(F.max(F.struct("signature", "name")).alias("c")).where("key is not null").withColumn("label", F.lit("Function"))
    both = nodes.join(last, NODE, "left")
    hit = F.col("c").isNotNull()
    old = both.withColumns({"name": F.when(hit, F.col("c.name")).otherwise(F.col("name")), "signature": F.when(hit, F.col("c.signature")).otherwise(F.col("signature")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))})
    own = {"name": F.col("c.name"), "signature": F.col("c.signature"), "node_type": F.lit("api"), "full_name": F.col("key"), "created_at": now, "updated_at": now}
    new = last.join(nodes, NODE, "left_anti").select(*[(F.col(c) if c in NODE else own.get(c, F.lit(None))).cast(kind).alias(c) for c, kind in nodes.dtypes])
    return old.select(*nodes.columns).unionByName(new)


def inheritance_edges(bases: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo_id, src_key, dst_key) of classes and bases with a type: IMPLEMENTS where the base is an interface, else INHERITS."""
    kinds = nodes.where("label = 'Class'").select("repo_id", F.col("key").alias("dst_key"), "node_type")
    return bases.join(kinds, ["repo_id", "dst_key"], "left").withColumn("type", F.when(F.col("node_type") == "interface", "IMPLEMENTS").otherwise("INHERITS")).drop("node_type")


def neighbours(edges: DataFrame, type_: str, target: Column | str, reverse: bool = False) -> DataFrame:
    """Distinct keys one edge away from the target, itself excluded; ``reverse`` follows edges backwards."""
    here, there = ("dst_key", "src_key") if reverse else ("src_key", "dst_key")
    own = edges.where((F.col("type") == type_) & (F.col(here) == target))
    return own.where(F.col(there).isNotNull() & (F.col(there) != F.col(here))).select(F.col(there).alias("key")).distinct()


def dependents(edges: DataFrame, file: str) -> DataFrame:
    """Files that depend on a file."""
    return neighbours(edges, "DEPENDS_ON", file, reverse=True)


def dependencies(edges: DataFrame, file: str) -> DataFrame:
    """Files that a file depends on."""
    return neighbours(edges, "DEPENDS_ON", file)


def all_pairs(edges: DataFrame, type_: str = "DEPENDS_ON") -> DataFrame:
    """Distinct (src_key, dst_key) of all edges of a type that are no loops."""
    return edges.where((F.col("type") == type_) & (F.col("src_key") != F.col("dst_key"))).select("src_key", "dst_key").distinct()


def dependents_by_use(edges: DataFrame, nodes: DataFrame, file: str) -> DataFrame:
    """Files whose functions call, or whose classes inherit from, what a file defines."""
    place = nodes.select("key", "file_path")
    used = edges.where(F.col("type").isin("CALLS", "INHERITS", "IMPLEMENTS"))
    own = place.where(F.col("file_path") == file).select(F.col("key").alias("dst_key"))
    users = used.join(own, "dst_key", "left_semi").join(place.withColumnRenamed("key", "src_key"), "src_key")
    return users.where(F.col("file_path") != file).select("file_path").distinct()


def file_summary(files: DataFrame, classes: DataFrame, methods: DataFrame, functions: DataFrame) -> DataFrame:
    """(file, classes: [(name, methods)], functions) for every file.

    ``files`` has file; ``classes`` file, class; ``methods`` class, method; ``functions`` file,
    function. Names that are null are left out; lists are in order.
    """
    of_class = methods.where("method is not null").groupBy("class").agg(F.array_sort(F.collect_list("method")).alias("methods"))
    nested = (
        classes.where("class is not null").join(of_class, "class", "left")
        .groupBy("file").agg(F.array_sort(F.collect_list(F.struct(F.col("class").alias("name"), F.coalesce("methods", F.array().cast("array<string>")).alias("methods")))).alias("classes"))
    )
    plain = functions.where("function is not null").groupBy("file").agg(F.array_sort(F.collect_list("function")).alias("functions"))
    empty = "array<struct<name:string,methods:array<string>>>"
    return files.join(nested, "file", "left").join(plain, "file", "left").select(
        "file", F.coalesce("classes", F.array().cast(empty)).alias("classes"), F.coalesce("functions", F.array().cast("array<string>")).alias("functions")
    )


def top_level(functions: DataFrame, contained: DataFrame, key: str) -> DataFrame:
    """Functions that no class contains."""
    return functions.join(contained, key, "left_anti")


def reachable(pairs: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """(key, depth): what can be reached over (src, dst), in at most ``depth`` steps if that is given, with the least number of steps.

    Each round joins only what the last one added, and cuts the lineage; it ends when nothing is new.
    """
    seen = frontier = materialize(start.select("key").distinct().withColumn("depth", F.lit(0)), "depth0")
    for step in count(1) if depth is None else range(1, depth + 1):
        new = frontier.join(pairs, frontier.key == pairs.src).select(F.col("dst").alias("key")).distinct().join(seen, "key", "left_anti")
        frontier = materialize(new.withColumn("depth", F.lit(step)), f"depth{step}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if step % 16 == 0:  # so that the plan does not grow with the depth
            seen = materialize(seen, f"seen{step}")
    return seen


def closure(victims: DataFrame, contains: DataFrame) -> DataFrame:
    """The nodes in or under ``victims`` (column key) by containment edges (src, dst), at any depth."""
    return reachable(contains, victims).select("key")


def under_folder(path: Column, folder: str) -> Column:
    """The folder itself or a path below it; siblings that start alike are not."""
    return (path == folder.rstrip("/")) | path.startswith(folder.rstrip("/") + "/")


def without(nodes: DataFrame, edges: DataFrame, victims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after the victims (column key) and all edges at them are gone."""
    ends = [victims.select(F.col("key").alias(c)) for c in ("src_key", "dst_key")]
    left = edges.join(ends[0], "src_key", "left_anti").join(ends[1], "dst_key", "left_anti").select(*edges.columns)
    return nodes.join(victims, "key", "left_anti").select(*nodes.columns), left


def stale(nodes: DataFrame, before: Column) -> DataFrame:
    """Nodes other than projects last updated before a time; those never updated are not stale."""
    return nodes.where((F.col("label") != "Project") & (F.col("updated_at") < before))


def symbols_like(nodes: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Workspace symbols: the first names that contain the query."""
    return nodes.where(F.col("name").contains(query)).orderBy("name", "key").limit(limit)


def edges_of(rows: DataFrame, kinds: dict[str, tuple[str, str, str, str]]) -> DataFrame:
    """Edges from exploded rows: type -> (source label, source column, target label, target column)."""
    parts = [
        rows.select("repo_id", F.lit(t).alias("type"), F.lit(sl).alias("src_label"), F.col(s).alias("src_key"), F.lit(dl).alias("dst_label"), F.col(d).alias("dst_key"), "updated_at")
        for t, (sl, s, dl, d) in kinds.items()
    ]
    return reduce(DataFrame.unionByName, parts).where("src_key is not null and dst_key is not null").dropDuplicates(EDGE)
