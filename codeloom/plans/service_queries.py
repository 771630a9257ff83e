"""Queries of stored tables, the graph's tables, scans, trees, summaries and small text functions on the test tables."""

from pyspark.sql import functions as F

from codeloom.functions import embedding, other_code, python_code
from codeloom.functions import text as t
from codeloom.operators import graph as g
from codeloom.operators import meta as m
from codeloom.operators import repos as r
from codeloom.operators import search as s
from codeloom.operators import tree
from codeloom.operators.store import Store
from codeloom.plans.code_queries import _code
from codeloom.sources.scratch import scratch_folder
from codeloom.sources.tables import read_table

DAY = "timestamp '2024-05-{:02d} 00:00:00'"


def _day(n):
    return F.expr(DAY.format(n))


def _text(prefix, c):
    return F.concat(F.lit(prefix), F.col(c).cast("string") if isinstance(c, str) else c.cast("string"))


# stored tables


def store_changes(spark, sf_dir):
    """Customers by segment: a table is created, rows come in, some are changed, one by id, some go."""
    store = Store(spark, scratch_folder(spark))
    rows = read_table(spark, sf_dir, "customer").select(_text("", "c_custkey").alias("id"), F.col("c_mktsegment").alias("repo_id"), F.col("c_nationkey").cast("int").alias("n"))
    store.create("customers", "id string, repo_id string, n int")
    store.upsert("customers", rows, ["repo_id", "id"])
    store.upsert("customers", rows.where("id % 5 = 0").withColumn("n", F.col("n") + 100), ["repo_id", "id"])
    store.update_by_id("customers", "7", {"n": -1})
    store.delete("customers", {"repo_id": "BUILDING", "n": [3, 4]})
    store.update("customers", {"repo_id": ["MACHINERY", "AUTOMOBILE"], "n": [5, 105]}, {"remove": "n"})
    return store.read("customers")


def ids_filter(spark, sf_dir):
    df = read_table(spark, sf_dir, "embeddings")
    return df.where(s.condition(df, {"vec_id": [3, 5, 8, 13, 100_000], "label": [*range(8)]})).select("vec_id", "label")


def search_fill(spark, sf_dir):
    """Near rows first, then the others that pass the filter, with score 0."""
    emb = read_table(spark, sf_dir, "embeddings")
    vector = emb.where("vec_id = 0").first().embedding
    request = s.SearchRequest(select=("label",), condition={"label": [1, 2]}, match=(s.MatchDense("embedding", tuple(vector), 5),), limit=30, fill=True, id_field="vec_id")
    return s.search([emb], request).hits.select("vec_id", "label", F.round("score", 6).alias("score"))


# the graph's tables


def _files(spark, sf_dir):
    """Suppliers as nodes."""
    return read_table(spark, sf_dir, "supplier").select(
        F.lit("r").alias("repo_id"), F.when(F.col("s_nationkey") % 3 == 0, "Class").otherwise("File").alias("label"), _text("s", "s_suppkey").alias("key"), F.col("s_name").alias("name"),
        F.when(F.col("s_nationkey") % 6 == 0, "interface").otherwise("class").alias("node_type"), F.lit(None).cast("string").alias("signature"), F.lit(None).cast("string").alias("full_name"),
        _text("n", "s_nationkey").alias("file_path"), _day(1).alias("created_at"), _day(1).alias("updated_at"),
    )


def _uses(spark, sf_dir):
    """Distinct pairs of suppliers, by the numbers of orders."""
    o = read_table(spark, sf_dir, "orders")
    return o.select(_text("s", F.col("o_custkey") % 60).alias("src_key"), _text("s", F.col("o_orderkey") % 130).alias("dst_key")).distinct()


def graph_nodes_upsert(spark, sf_dir):
    old = _files(spark, sf_dir)
    new = old.where("key like '%3'").withColumns({"name": F.upper("name"), "created_at": _day(9), "updated_at": _day(9)})
    more = new.withColumn("key", F.concat("key", F.lit("x")))
    return g.upsert_nodes(old, new.union(more)).select("key", "label", "name", "created_at", "updated_at")


def graph_edges_upsert(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    edges = o.select(
        F.lit("r").alias("repo_id"), F.lit("DEPENDS_ON").alias("type"), F.lit("File").alias("src_label"), _text("s", F.col("o_custkey") % 50).alias("src_key"), F.lit("File").alias("dst_label"),
        _text("s", F.col("o_orderkey") % 40).alias("dst_key"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderkey").alias("k"),
    )
    return g.upsert_edges(edges.where("k % 2 = 0").drop("k"), edges.where("k % 2 = 1").drop("k")).select("src_key", "dst_key", "updated_at")


def graph_stubs(spark, sf_dir):
    edges = _uses(spark, sf_dir).select(F.lit("r").alias("repo_id"), F.lit("Class").alias("dst_label"), _text("pkg.", "dst_key").alias("dst_key"))
    nodes = _files(spark, sf_dir).where("label = 'Class'").withColumn("key", _text("pkg.", "key"))
    return g.stub_endpoints(nodes, edges, "Class", "class").select("key", "name", "full_name", "node_type")


def inheritance_kinds(spark, sf_dir):
    return g.inheritance_edges(_uses(spark, sf_dir).withColumn("repo_id", F.lit("r")), _files(spark, sf_dir)).select("src_key", "dst_key", "type")


def containment_edges(spark, sf_dir):
    """Customers in nations in regions, as edges of two kinds."""
    region, nation, customer = (read_table(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select(F.lit("r").alias("repo_id"), F.col("r_name").alias("folder"), F.col("n_name").alias("file"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("function"), _day(1).alias("updated_at"))
    edges = g.edges_of(rows, {"HAS_FILE": ("Folder", "folder", "File", "file"), "CONTAINS": ("File", "file", "Function", "function")})
    return edges.select("type", "src_label", "src_key", "dst_label", "dst_key")


def calls_named(spark, sf_dir):
    nodes = _files(spark, sf_dir).withColumn("label", F.lit("Function"))
    calls = _uses(spark, sf_dir).select(F.lit("r").alias("repo_id"), "dst_key", F.upper("dst_key").alias("name"), F.concat(F.upper("dst_key"), F.lit("("), "src_key", F.lit(")")).alias("signature"))
    return g.called(nodes, calls, _day(7)).select("key", "name", "signature", "node_type", "updated_at")


def users_of_a_file(spark, sf_dir):
    edges = _uses(spark, sf_dir).withColumn("type", F.when(F.col("src_key") < "s3", "CALLS").otherwise("INHERITS"))
    return g.dependents_by_use(edges, _files(spark, sf_dir), "n7")


def symbols_like(spark, sf_dir):
    nodes = read_table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), _text("", "p_partkey").alias("key"))
    return g.symbols_like(nodes, "ring", 10)


def under_folder(spark, sf_dir):
    path = F.concat(F.lit("src"), F.col("p_size") % 3, F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.concat(F.lit("/f"), F.col("p_partkey"))))
    df = read_table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(path, "^src0", "src").alias("path"))
    return df.where(g.under_folder(F.col("path"), "src/")).select("p_partkey", "path")


def dependency_lists(spark, sf_dir):
    """Sorted dependencies of every file, one list each."""
    return _uses(spark, sf_dir).groupBy("src_key").agg(F.array_join(F.array_sort(F.collect_set("dst_key")), ",").alias("dependencies"))


# scans and states


def _tasks(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, ["idle", "running", "completed", "failed"])), (F.col("c_custkey") % 4 + 1).cast("int"))
    return read_table(spark, sf_dir, "customer").select(_text("", "c_custkey").alias("repo_id"), status.alias("scan_status"), *[_day(1).alias(c) for c in ("last_scan_started_at", "scan_heartbeat_at", "created_at", "updated_at")])


def scan_start(spark, sf_dir):
    """One that is free, one that runs already, and one that is new."""
    tasks = _tasks(spark, sf_dir)
    for repo in ("2", "5", "new"):
        tasks = m.may_start(tasks, repo, _day(8))
    return tasks.select("repo_id", "scan_status", "scan_heartbeat_at")


def finish_results(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").where("event_id % 20 < 4")
    path = _text("f", "event_id").alias("file_path")
    states = e.select(F.lit("r").alias("repo_id"), path, F.lit("running").alias("status"), F.lit(1).alias("attempts"), F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("timestamp").alias("last_finished_at"), _day(1).alias("updated_at"))
    results = e.where("event_id % 20 < 3").select(F.lit("r").alias("repo_id"), path, (F.col("event_type") != "error").alias("ok"), F.when(F.col("event_type") == "error", F.col("props")).alias("error"))
    return m.finish(states, results, _day(5)).select("file_path", "status", "last_error", "last_finished_at", "updated_at")


def work_items(spark, sf_dir):
    states = read_table(spark, sf_dir, "orders").select(_text("", "o_orderkey").alias("id"), "o_custkey", "o_orderstatus")
    return r.work_item(states, "42").union(r.work_item(states, "77")).union(r.work_item(states, "absent"))


def repositories_page(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("repository_name"), F.col("o_orderstatus").alias("description"), F.lit(None).cast("string").alias("organization"), (F.col("o_custkey") % 20).alias("user_id"), F.col("o_orderdate").alias("created_at"),
    )
    return m.list_repositories(o, "urgent", 2, 15, user_id=7)[1].select("id", "repository_name", "created_at")


def ignored_names(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    gone = t.ignored(F.col("p_name"), F.col("p_size") % 2 == 0, ["small*", "*ring/", "RED widget", "# blue*", "", "*a*b*/"])
    return part.where(~gone).select("p_partkey", "p_name")


# trees


def _tree(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    path = F.concat_ws("/", F.regexp_replace("p_brand", "#", ""), F.when(F.col("p_size") % 3 != 0, F.col("p_type")), F.regexp_replace("p_name", " ", "_"))
    return tree.nodes(part.select(F.concat(path, F.when(F.col("p_partkey") % 11 == 0, "/").otherwise("")).alias("path")))


def _lines(lines):
    return lines.select(F.array_join("key", "/").alias("key"), "line")


def tree_listed(spark, sf_dir):
    return _lines(tree.listed(_tree(spark, sf_dir)))


def tree_compact(spark, sf_dir):
    return _lines(tree.compact(_tree(spark, sf_dir)))


def tree_compressed(spark, sf_dir):
    return _lines(tree.compressed(_tree(spark, sf_dir)))


def tree_unix(spark, sf_dir):
    return _lines(tree.unix(_tree(spark, sf_dir)))


def tree_plain(spark, sf_dir):
    return _tree(spark, sf_dir).where("depth > 0").groupBy("parent").agg(tree.catalogue(F.col("name")).alias("lines"))


# symbols and dependencies


def symbol_records(spark, sf_dir):
    out = embedding.symbol_summaries(python_code.symbols(_code(spark, sf_dir)), "r", 8)
    return out.select("file_path", "symbol_kind", "symbol_name", "start_line", "end_line", "summary")


def low_information(spark, sf_dir):
    """Accessors made of the rows of ``part``, in three languages."""
    k = F.col("p_partkey")
    language = F.element_at(F.array(*map(F.lit, ["python", "go", "java"])), (k % 3 + 1).cast("int"))
    name = F.concat(F.element_at(F.array(*map(F.lit, ["get_x", "GetX", "getX", "run", "is_y"])), (k % 5 + 1).cast("int")))
    source = F.concat(name, F.lit("\n\n# note\n"), F.repeat(F.lit("return 1\n"), (k % 9).cast("int")), F.lit("  // end"))
    rows = read_table(spark, sf_dir, "part").select("p_partkey", language.alias("language"), name.alias("name"), source.alias("source"))
    return rows.where(embedding.low_information(F.col("source"), F.col("language"), F.col("name"))).select("p_partkey", "language", "name")


def other_deps(spark, sf_dir):
    """Imports of C, Go, Java and JavaScript files made of the rows of ``part``."""
    k = F.col("p_partkey")
    part = read_table(spark, sf_dir, "part").where("p_partkey < 5000")
    some = part.where("p_partkey < 20")

    def made(rows, path, content):
        return rows.select(F.concat(*path).alias("path"), F.concat(*content).alias("content"))

    lit, q = F.lit, F.lit('"')
    files = {
        "c": made(part, (lit("c/a"), k, lit(".c")), (lit("#include "), q, lit("h"), k % 50, lit('.h"\n#include "../inc/x'), k % 20, lit('.h"\n#include <none.h>\n#include "inc/x'), k % 3, lit('.h"\n')))
        .union(made(some, (lit("c/h"), k, lit(".h")), (lit(""),))).union(made(some, (lit("inc/x"), k, lit(".h")), (lit(""),))),
        "go": made(part, (lit("cmd/a"), k, lit("/main.go")), (lit("package main\n\nimport (\n\t"), q, lit("ex.com/m/lib"), k % 30, lit('"\n\tx "fmt"\n)\n')))
        .union(made(some, (lit("lib"), k, lit("/one.go")), (lit(""),))).union(made(some, (lit("lib"), k, lit("/one_test.go")), (lit(""),))),
        "java": made(part, (lit("m"), k % 2, lit("/src/main/java/a/A"), k, lit(".java")), (lit("package a;\nimport b.B"), k % 30, lit(";\nimport static b.B"), k % 7, lit(".run;\nimport java.util.List;\n")))
        .union(made(some, (lit("m1/src/main/java/b/B"), k, lit(".java")), (lit(""),))).union(made(some.where("p_partkey < 10"), (lit("m0/src/main/java/b/B"), k, lit(".java")), (lit(""),))),
        "javascript": made(part, (lit("w/s"), k, lit(".js")), (lit("import a from './lib"), k % 30, lit("'\nconst b = require(\"../util/u"), k % 25, lit(".js\")\nimport 'node:fs'\n")))
        .union(made(some, (lit("w/lib"), k, lit("/index.js")), (lit(""),))).union(made(some, (lit("util/u"), k, lit(".js")), (lit(""),))),
    }
    out = None
    for language, rows in files.items():
        found = other_code.file_dependencies(rows, language, "ex.com/m" if language == "go" else None).withColumn("language", F.lit(language))
        out = found if out is None else out.union(found)
    return out.select("language", "src", "dst")


# small functions


def strip_thoughts(spark, sf_dir):
    said = F.concat(F.lit("< Think >"), F.substring("text", 1, 40), F.lit("\n</think > "), F.substring("text", 41, 60), F.lit("<think>again</think>"))
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(t.strip_thoughts(said)).alias("text_md5"))


def folded_paths(spark, sf_dir):
    k = F.col("p_partkey")
    path = F.concat(F.lit("./a"), k, F.lit("/../b"), k % 7, F.lit("//c/."), F.when(k % 2 == 0, "/d/../..").otherwise("/"))
    return read_table(spark, sf_dir, "part").select("p_partkey", t.fold_path(path).alias("path"))


def floats(spark, sf_dir):
    value = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(" "), F.col("p_size"), F.lit(".5e1 "))).otherwise(F.lit(None))
    return read_table(spark, sf_dir, "part").select("p_partkey", t.to_float(value).alias("value"))


def retryable_errors(spark, sf_dir):
    words = ["Rate Limit reached", "HTTP 503", "invalid key", "connection reset; prompt is too long", "Too many tokens", "gateway TIMEOUT", "not found"]
    message = F.concat("p_type", F.lit(": "), F.element_at(F.array(*map(F.lit, words)), (F.col("p_partkey") % 7 + 1).cast("int")))
    return read_table(spark, sf_dir, "part").select("p_partkey", t.retryable(message).alias("again"), t.mentions(message, t.TOO_LONG).alias("too_long"))


def tool_call_texts(spark, sf_dir):
    args = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('{"size": '), F.col("p_size"), F.lit("}"))).otherwise(F.lit("no json"))
    calls = F.when(F.col("p_partkey") % 5 != 0, F.array(F.struct(_text("", "p_partkey").alias("id"), F.col("p_name").alias("name"), args.alias("arguments")))).otherwise(F.array().cast("array<struct<id:string,name:string,arguments:string>>"))
    return read_table(spark, sf_dir, "part").select("p_partkey", t.tool_calls(calls).alias("text"))


def mended_arguments(spark, sf_dir):
    """Objects with faults of five kinds, made of the rows of ``part``."""
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    kinds = [
        F.concat(F.lit('{"name": "'), name, F.lit('", "size": '), size, F.lit("}")), F.concat(F.lit("{name: '"), name, F.lit("', size: "), size, F.lit(",}")), F.concat(F.lit('```json\n{"name": "'), name, F.lit('" "size": '), size, F.lit("}\n```")),
        F.concat(F.lit("\"{\\\"name\\\": \\\""), name, F.lit("\\\", \\\"size\\\": "), size, F.lit('}"')), F.concat(F.lit('{"name": "'), name, F.lit('", "size": '), size, F.lit("} // done")),
    ]
    return read_table(spark, sf_dir, "part").select("p_partkey", t.arguments(F.element_at(F.array(*kinds), (F.col("p_partkey") % 5 + 1).cast("int"))).alias("arguments"))


NAMES = [
    store_changes, ids_filter, search_fill, graph_nodes_upsert, graph_edges_upsert, graph_stubs, inheritance_kinds, containment_edges, calls_named, users_of_a_file, symbols_like, under_folder, dependency_lists,
    scan_start, finish_results, work_items, repositories_page, ignored_names, tree_listed, tree_compact, tree_compressed, tree_unix, tree_plain, symbol_records, low_information, other_deps,
    strip_thoughts, folded_paths, floats, retryable_errors, tool_call_texts, mended_arguments,
]
QUERIES = {f.__name__: f for f in NAMES}

_D1, _D5, _D7, _D8, _D9 = (DAY.format(n) for n in (1, 5, 7, 8, 9))
_USES = "uses as (select distinct 's' || o_custkey % 60 as src_key, 's' || o_orderkey % 130 as dst_key from orders)"
_NODES = """nodes as (select 's' || s_suppkey as key, case when s_nationkey % 3 = 0 then 'Class' else 'File' end as label, s_name as name,
    case when s_nationkey % 6 = 0 then 'interface' else 'class' end as node_type, 'n' || s_nationkey as file_path from supplier)"""
_TREE = """p as (select string_split(concat_ws('/', replace(p_brand, '#', ''), case when p_size % 3 <> 0 then p_type end, replace(p_name, ' ', '_')), '/') as x, p_partkey % 11 = 0 as dir from part),
    n as (select array_to_string(x[1:i], '/') as path, array_to_string(x[1:i-1], '/') as parent, x[i] as name, i - 1 as depth, bool_or(i < len(x) or dir) as is_dir
      from (select x, dir, unnest(generate_series(1, len(x))) as i from p) group by all),
    k as (select *, array_to_string(list_transform(string_split(path, '/'), lambda s, j: case when j <= depth or is_dir then '0' else '1' end || s), '/') as key from n)"""


ORACLES = {
    "store_changes": """with c as (select c_custkey::varchar as id, c_mktsegment as repo_id, case when c_custkey = 7 then -1 when c_custkey % 5 = 0 then c_nationkey + 100 else c_nationkey end::int as n from customer)
        select id, repo_id, case when repo_id in ('MACHINERY', 'AUTOMOBILE') and n in (5, 105) then null else n end as n from c where not (repo_id = 'BUILDING' and n in (3, 4))""",
    "ids_filter": "select vec_id, label from embeddings where vec_id in (3, 5, 8, 13) and label between 0 and 7",
    "search_fill": """with e as (select vec_id, label, (list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)) + 1) / 2 as score from embeddings where label in (1, 2)),
        near as (select vec_id, score from e order by score desc, vec_id limit 5)
        select e.vec_id, e.label, round(coalesce(n.score, 0), 6) as score from e left join near n on n.vec_id = e.vec_id order by coalesce(n.score, 0) desc, e.vec_id limit 30""",
    "graph_nodes_upsert": f"""with {_NODES} select key, label, case when key like '%3' then upper(name) else name end as name, {_D1} as created_at, case when key like '%3' then {_D9} else {_D1} end as updated_at from nodes
        union all select key || 'x', label, upper(name), {_D9}, {_D9} from nodes where key like '%3'""",
    "graph_edges_upsert": "select 's' || o_custkey % 50 as src_key, 's' || o_orderkey % 40 as dst_key, max(o_orderdate) as updated_at from orders group by all",
    "graph_stubs": f"""with {_USES}, {_NODES} select distinct 'pkg.' || dst_key as key, dst_key as name, 'pkg.' || dst_key as full_name, 'class' as node_type from uses
        where dst_key not in (select key from nodes where label = 'Class')""",
    "inheritance_kinds": f"""with {_USES}, {_NODES} select u.src_key, u.dst_key, case when n.node_type = 'interface' then 'IMPLEMENTS' else 'INHERITS' end as type
        from uses u left join nodes n on n.key = u.dst_key and n.label = 'Class'""",
    "containment_edges": """select distinct 'HAS_FILE' as type, 'Folder' as src_label, r_name as src_key, 'File' as dst_label, n_name as dst_key from nation join region on r_regionkey = n_regionkey join customer on c_nationkey = n_nationkey
        union all select distinct 'CONTAINS', 'File', n_name, 'Function', c_name from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey where c_custkey % 4 <> 0""",
    "calls_named": f"""with {_USES}, {_NODES}, c as (select dst_key, max(upper(dst_key) || '(' || src_key || ')') as signature from uses group by dst_key)
        select n.key, case when c.dst_key is null then n.name else upper(n.key) end as name, c.signature, n.node_type, case when c.dst_key is null then {_D1} else {_D7} end as updated_at from nodes n left join c on c.dst_key = n.key
        union all select dst_key, upper(dst_key), signature, 'api', {_D7} from c where dst_key not in (select key from nodes)""",
    "users_of_a_file": f"""with {_USES}, {_NODES} select distinct a.file_path from uses u join nodes b on b.key = u.dst_key and b.file_path = 'n7' join nodes a on a.key = u.src_key where a.file_path <> 'n7'""",
    "symbols_like": "select p_name as name, p_partkey::varchar as key from part where contains(p_name, 'ring') order by p_name, p_partkey::varchar limit 10",
    "under_folder": "select * from (select p_partkey, 'src' || nullif(p_size % 3, 0)::varchar || tail as path from (select *, case when p_partkey % 7 = 0 then '' else '/f' || p_partkey end as tail from part) where p_size % 3 <> 0 union all select p_partkey, 'src' || case when p_partkey % 7 = 0 then '' else '/f' || p_partkey end from part where p_size % 3 = 0) where path = 'src' or starts_with(path, 'src/')",
    "dependency_lists": f"with {_USES} select src_key, string_agg(dst_key, ',' order by dst_key) as dependencies from uses group by src_key",
    "scan_start": f"""with t as (select c_custkey::varchar as repo_id, case c_custkey % 4 when 0 then 'idle' when 1 then 'running' when 2 then 'completed' else 'failed' end as scan_status from customer)
        select repo_id, case when repo_id = '2' then 'running' else scan_status end as scan_status, case when repo_id = '2' then {_D8} else {_D1} end as scan_heartbeat_at from t union all select 'new', 'running', {_D8}""",
    "finish_results": f"""select 'f' || event_id as file_path, case when event_id % 20 = 3 then 'running' when event_type = 'error' then 'failed' else 'completed' end as status,
        case when event_id % 20 < 3 and event_type = 'error' then props end as last_error, case when event_id % 20 < 3 and event_type <> 'error' then {_D5} end as last_finished_at,
        case when event_id % 20 < 3 then {_D5} else {_D1} end as updated_at from events where event_id % 20 < 4""",
    "work_items": "select o_orderkey::varchar as id, o_custkey, o_orderstatus from orders where o_orderkey in (42, 77)",
    "repositories_page": "select o_orderkey as id, o_orderpriority as repository_name, o_orderdate as created_at from orders where contains(lower(o_orderpriority), 'urgent') and o_custkey % 20 = 7 order by o_orderdate desc, o_orderkey limit 15 offset 15",
    "ignored_names": """select p_partkey, p_name from part where not (lower(p_name) like 'small%' or lower(p_name) = 'red widget' or p_size % 2 = 0 and (lower(p_name) like '%ring' or lower(p_name) like '%a%b%'))""",
    "tree_listed": f"with {_TREE} select key, path || case when is_dir then '/(D)' else '' end as line from k",
    "tree_compact": f"with {_TREE} select key, repeat('  ', depth) || name || case when is_dir then '/D' else '/F' end as line from k",
    "tree_compressed": f"with {_TREE} select key, path || case when is_dir then '/' else '' end as line from k where not is_dir or (select count(*) from n c where c.parent = k.path) <> 1",
    "tree_unix": f"""with {_TREE}, l as (select *, row_number() over (partition by parent order by string_split(key, '/') desc) = 1 as last from k),
        up as (select l.path, string_agg(case when u.last then '    ' else '│   ' end, '' order by u.depth) as lead from l join l u on u.depth < l.depth and starts_with(l.path, u.path || '/') group by l.path)
        select l.key, coalesce(up.lead, '') || case when l.last then '└── ' else '├── ' end || l.name || case when l.is_dir then '/' else '' end as line from l left join up on up.path = l.path""",
    "tree_plain": f"with {_TREE} select parent, string_agg(name, chr(10) order by name) as lines from n where depth > 0 group by parent",
    "symbol_records": """with m as (select 'pkg' || p_partkey % 7 || '/m' || p_partkey || '.py' as path, p_partkey as k, (p_partkey + 2) % 7 as b, p_name, p_size from part)
        select path as file_path, 'class' as symbol_kind, 'C' || k as symbol_name, 13 as start_line, 21 as end_line,
          'class C' || k || ': class C' || k || '(C' || b || '): kind = ' || chr(39) || p_name || chr(39) || ' def get_kind(self, x: int) -> str: total = x + ' || p_size as summary from m union all
        select path, 'function', 'helper', 24, 29, 'function helper: def helper(n, *rest): if n: return len(str(n)) return C' || b || '(n, ' || p_size || ')' from m""",
    "low_information": """with p as (select p_partkey, ['python', 'go', 'java'][p_partkey % 3 + 1] as language, ['get_x', 'GetX', 'getX', 'run', 'is_y'][p_partkey % 5 + 1] as name, 1 + p_partkey % 9 as n from part)
        select p_partkey, language, name from p where language = 'python' and name in ('get_x', 'is_y') and n > 1 and n <= 4 or language = 'go' and name = 'GetX' and n <= 5
          or language = 'java' and name in ('get_x', 'getX', 'is_y') and n <= 7""",
    "other_deps": """with p as (select p_partkey as k from part where p_partkey < 5000)
        select distinct language, src, dst from (
          select 'c' as language, 'c/a' || k || '.c' as src, 'c/h' || k % 50 || '.h' as dst from p where k % 50 < 20 union all select 'c', 'c/a' || k || '.c', 'inc/x' || k % 20 || '.h' from p union all
          select 'c', 'c/a' || k || '.c', 'inc/x' || k % 3 || '.h' from p union all select 'go', 'cmd/a' || k || '/main.go', 'lib' || k % 30 || '/one.go' from p where k % 30 < 20 union all
          select 'java', 'm' || k % 2 || '/src/main/java/a/A' || k || '.java', 'm' || case when x < 10 then k % 2 else 1 end || '/src/main/java/b/B' || x || '.java' from (select k, unnest([k % 30, k % 7]) as x from p) where x < 20 union all
          select 'javascript', 'w/s' || k || '.js', 'w/lib' || k % 30 || '/index.js' from p where k % 30 < 20 union all select 'javascript', 'w/s' || k || '.js', 'util/u' || k % 25 || '.js' from p where k % 25 < 20)""",
    "strip_thoughts": "select conv_id, turn, md5(trim(' ' || substring(text, 41, 60), ' ')) as text_md5 from conversations",
    "folded_paths": "select p_partkey, 'b' || p_partkey % 7 || case when p_partkey % 2 = 0 then '' else '/c' end as path from part",
    "floats": "select p_partkey, case when p_partkey % 3 = 1 then p_size * 10.0 + 5 else '-inf'::double end as value from part",
    "retryable_errors": "select p_partkey, p_partkey % 7 in (0, 1, 5) as again, p_partkey % 7 in (3, 4) as too_long from part",
    "tool_call_texts": """select p_partkey, case when p_partkey % 5 = 0 then '' else '<tool_calls>' || chr(10) || '<tool>' || chr(10) || '{' || chr(10) || '  "id": "' || p_partkey || '",' || chr(10) || '  "name": "' || p_name || '",' || chr(10) ||
        case when p_partkey % 2 = 0 then '  "args": {' || chr(10) || '    "size": ' || p_size || chr(10) || '  }' else '  "args": "no json"' end || chr(10) || '}' || chr(10) || '</tool>' || chr(10) || '</tool_calls>' end as text from part""",
    "mended_arguments": """select p_partkey, '{"name": "' || p_name || '", "size": ' || p_size || '}' as arguments from part""",
}
