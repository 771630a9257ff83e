"""Graph, table and state queries on the test tables: suppliers stand for files, parts for what they depend on."""

from pyspark.sql import functions as F

from codeloom.operators import graph as g
from codeloom.operators import meta as m
from codeloom.operators import repos as r
from codeloom.operators import store as st
from codeloom.sources.tables import read_table


def _edges(spark, sf_dir):
    """Suppliers depend on the supplier whose number a part's number leads to, as keys s<number>."""
    li = read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    to = F.concat(F.lit("s"), (F.col("l_partkey") % 97 + 1).cast("string"))
    return li.select(
        F.lit("r").alias("repo_id"), F.lit("DEPENDS_ON").alias("type"), F.lit("File").alias("src_label"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src_key"),
        F.lit("File").alias("dst_label"), to.alias("dst_key"), F.lit(None).cast("timestamp").alias("updated_at"),
    )


def dependents(spark, sf_dir):
    return g.dependents(_edges(spark, sf_dir), "s7")


def dependented(spark, sf_dir):
    return g.dependencies(_edges(spark, sf_dir), "s7")


def dependency_degree(spark, sf_dir):
    pairs = g.all_pairs(_edges(spark, sf_dir))
    return pairs.groupBy("src_key").agg(F.count(F.lit(1)).alias("n_dependencies"))


def file_summary_nested(spark, sf_dir):
    region, nation, customer, supplier = (read_table(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier"))
    files = region.select(F.col("r_name").alias("file"))
    classes = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("file"), F.col("n_name").alias("class"))
    methods = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("class"), F.col("c_name").alias("method"))
    functions = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("file"), F.col("s_name").alias("function"))
    out = g.file_summary(files, classes, methods, functions)
    text = F.array_join(F.transform("classes", lambda c: F.concat(c["name"], F.lit(":"), F.array_join(c["methods"], ","))), ";")
    return out.select("file", text.alias("classes"), F.array_join("functions", ",").alias("functions"))


def toplevel_anti(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    return g.top_level(docs, read_table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


def _contains(spark, sf_dir):
    key = lambda t, c: F.concat(F.lit(t), F.col(c).cast("string"))
    nation, customer = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "customer")
    return nation.select(key("r", "n_regionkey").alias("src"), key("n", "n_nationkey").alias("dst")).unionByName(customer.select(key("n", "c_nationkey").alias("src"), key("c", "c_custkey").alias("dst")))


def cascade_victims(spark, sf_dir):
    return g.closure(spark.range(1).select(F.lit("r2").alias("key")), _contains(spark, sf_dir))


def graph_reachability(spark, sf_dir):
    pairs = g.all_pairs(_edges(spark, sf_dir)).select(F.col("src_key").alias("src"), F.col("dst_key").alias("dst"))
    return g.reachable(pairs, spark.range(1).select(F.lit("s1").alias("key")), 3)


def _states(spark, sf_dir):
    """The last event of each user stands for the state of a file."""
    events = read_table(spark, sf_dir, "events")
    return events.groupBy("user_id").agg(F.max_by(F.struct("event_type", "ts", "event_id"), F.struct("ts", "event_id")).alias("e")).select("user_id", "e.event_type", "e.ts", "e.event_id")


def stale_sweep(spark, sf_dir):
    nodes = _states(spark, sf_dir).select(F.col("user_id").alias("key"), F.when(F.col("user_id") % 10 == 0, "Project").otherwise("File").alias("label"), F.col("ts").alias("updated_at"))
    return g.stale(nodes, F.lit("2024-01-29 00:00:00").cast("timestamp")).select("key", "label")


def incremental_diff(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    known = _states(spark, sf_dir).where("user_id % 3 <> 0")
    stamp = F.lit(None).cast("timestamp")
    states = known.select(
        F.lit("r").alias("repo_id"), F.col("user_id").cast("string").alias("file_path"), F.lit("completed").alias("status"), F.lit(1).alias("attempts"), F.lit(None).cast("string").alias("last_error"),
        stamp.alias("last_started_at"), F.when(F.col("user_id") % 5 > 0, F.lit("2024-01-29 12:00:00").cast("timestamp")).alias("last_finished_at"), stamp.alias("created_at"), stamp.alias("updated_at"),
    )
    scan = events.groupBy("user_id").agg(F.max("ts").alias("mtime")).where("user_id % 7 <> 0").select(F.lit("r").alias("repo_id"), F.col("user_id").cast("string").alias("file_path"), "mtime")
    return m.diff(states, scan, F.lit("2024-02-01 00:00:00").cast("timestamp")).select("file_path", "status")


def _paths(spark, sf_dir):
    url = F.regexp_replace("url", r"^[a-z]+://", "")
    return read_table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(url, r"[?#].*$", "").alias("file_path"))


def missing_antijoin(spark, sf_dir):
    pages = _paths(spark, sf_dir)
    seen = pages.where("page_id % 2 = 0").select("file_path")
    return r.gone_from_scan(pages, seen, ["file_path"]).select("page_id", "file_path")


def excluded_dirs(spark, sf_dir):
    """Pages under none of some folders of two names, and not themselves among some paths."""
    pages = _paths(spark, sf_dir)
    folders = pages.where("page_id % 5 = 0").select(F.regexp_extract("file_path", r"^([^/]+/[^/]+)/", 1).alias("folder")).where("folder <> ''")
    return r.outside(pages, folders.unionByName(pages.where("page_id % 7 = 0").select(F.col("file_path").alias("folder"))))


def prefix_semijoin(spark, sf_dir):
    pages = _paths(spark, sf_dir)
    folders = pages.where("page_id % 5 = 0").select(F.regexp_extract("file_path", r"^([^/]+)/", 1).alias("folder")).where("folder <> ''")
    return m.under_any(pages, folders.distinct())


def _customers(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def upsert_by_id(spark, sf_dir):
    c = _customers(spark, sf_dir)
    new = c.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.lit(0.0)).unionByName(c.where("c_custkey % 100 = 1").withColumn("c_custkey", F.col("c_custkey") + 10_000_000))
    return st.upsert(c, new, ["c_custkey"])


def update_by_query(spark, sf_dir):
    return st.update(_customers(spark, sf_dir), {"c_mktsegment": ["BUILDING", "MACHINERY"], "c_nationkey": 7}, {"c_name": "it's\nnew", "c_acctbal": 1})


def delete_by_query(spark, sf_dir):
    return st.delete(_customers(spark, sf_dir), {"c_mktsegment": "BUILDING"})[0]


def queue_head(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").where("event_type in ('view', 'click')")
    return m.heads(events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def _repositories(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("u"), F.col("c_nationkey")).alias("user_id"), F.concat(F.lit("/srv/./"), "c_mktsegment", F.lit("/../"), "c_name").alias("local_path"),
        *[F.lit(None).cast("string").alias(x) for x in ("git_provider", "repository_url", "organization", "repository_name", "branch")], F.col("c_name").alias("description"), F.lit(None).cast("timestamp").alias("updated_at"),
    )


def resolve_by_path(spark, sf_dir):
    repos = _repositories(spark, sf_dir)
    name = repos.where("id = '7'").select("description").first()[0]
    return r.resolve(repos, path=f"srv\\x\\..\\{name}").select("id", "local_path")


def update_owned(spark, sf_dir):
    repos = _repositories(spark, sf_dir)
    user = repos.where("id = '7'").select("user_id").first()[0]
    out = r.update_repository(repos, "7", user, F.lit("2024-02-01 00:00:00").cast("timestamp"), description="new", url=" https://GitHub.com/org/name.git ")
    return out.select("id", "description", "git_provider", "organization", "repository_name", F.col("updated_at").isNotNull().alias("changed"))


def delete_cascade(spark, sf_dir):
    """Orders and line items stand for what belongs to a repository, a customer."""
    repos = _repositories(spark, sf_dir)
    user = repos.where("id = '7'").select("user_id").first()[0]
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("repo_id"), "o_orderkey")
    items = read_table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("repo_id", "l_orderkey")
    left, tables = r.delete_repository(repos, {"orders": orders, "items": items}, "7", user)
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in {"repositories": left, **tables}.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def delete_in_spaces(spark, sf_dir):
    c = _customers(spark, sf_dir)
    spaces = {"chunks": c.select("c_custkey", "c_mktsegment"), "symbols": c.where("c_nationkey < 9").select("c_custkey", "c_mktsegment")}
    return st.delete_in_spaces(spaces, {"c_mktsegment": ["BUILDING", "MACHINERY"]})[1]


def auth_upsert(spark, sf_dir):
    """Suppliers are the accounts there are, every third one active; customers save theirs."""
    at = lambda x: F.lit(f"2024-0{x}-01 00:00:00").cast("timestamp")
    who = lambda key, nation: [F.col(key).cast("string").alias("id"), F.concat(F.lit("u"), F.col(key)).alias("user_id"), F.when(F.col(nation) % 2 == 0, "github").otherwise("gitlab").alias("provider")]
    have = read_table(spark, sf_dir, "supplier").select(*who("s_suppkey", "s_nationkey"), (F.col("s_suppkey") % 3 == 0).alias("is_active"), at(1).alias("created_at"), at(1).alias("updated_at"))
    new = read_table(spark, sf_dir, "customer").select(*who("c_custkey", "c_nationkey"))
    return r.save_auth(have, new, at(2)).select("id", "user_id", "provider", "is_active", (F.col("updated_at") == at(2)).alias("touched"))


def heartbeat(spark, sf_dir):
    tasks = _states(spark, sf_dir).select(F.col("user_id").cast("string").alias("repo_id"), F.col("ts").alias("scan_heartbeat_at"))
    return r.heartbeat(tasks, "7", F.lit("2024-02-01 00:00:00").cast("timestamp")).select("repo_id", F.date_format("scan_heartbeat_at", "yyyy-MM-dd HH:mm:ss").alias("beat"))


def repos_with_work(spark, sf_dir):
    status = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "search", "failed").otherwise("completed")
    return r.repos_with_work(_states(spark, sf_dir).select((F.col("user_id") % 40).alias("repo_id"), status.alias("status")))


def claim_oldest(spark, sf_dir):
    stamp = F.lit(None).cast("timestamp")
    states = read_table(spark, sf_dir, "events").select(
        F.lit("r").alias("repo_id"), F.col("event_id").cast("string").alias("file_path"), F.when(F.col("event_type") == "view", "pending").otherwise("completed").alias("status"), F.lit(0).alias("attempts"),
        F.lit(None).cast("string").alias("last_error"), stamp.alias("last_started_at"), stamp.alias("last_finished_at"), stamp.alias("created_at"), F.col("ts").alias("updated_at"),
    )
    out = m.claim(states, 100, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return out.where("status = 'running'").select("file_path", "status", "attempts")


def events_stream_counts(spark, sf_dir):
    from codeloom.streaming.incremental import counts_by_day

    return counts_by_day(read_table(spark, sf_dir, "events"))


NAMES = [
    dependents, dependented, dependency_degree, file_summary_nested, toplevel_anti, cascade_victims, graph_reachability, stale_sweep, incremental_diff, missing_antijoin,
    prefix_semijoin, excluded_dirs, resolve_by_path, update_owned, delete_cascade, delete_in_spaces, auth_upsert, heartbeat, repos_with_work, upsert_by_id, update_by_query, delete_by_query, queue_head, claim_oldest, events_stream_counts,
]
QUERIES = {f.__name__: f for f in NAMES}

_E = "edges as (select distinct 's' || l_suppkey as src, 's' || (l_partkey % 97 + 1) as dst from lineitem)"
_LAST = "last as (select user_id, arg_max(event_type, (ts, event_id)) as event_type, max(ts) as ts from events group by user_id)"
_PATHS = "paths as (select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') as file_path from pages)"

ORACLES = {
    "dependents": f"with {_E} select distinct src as key from edges where dst = 's7' and src <> 's7'",
    "dependented": f"with {_E} select distinct dst as key from edges where src = 's7' and dst <> 's7'",
    "dependency_degree": f"with {_E} select src as src_key, count(*) as n_dependencies from edges where src <> dst group by src",
    "file_summary_nested": """with meth as (select n_name as class, string_agg(c_name, ',' order by c_name) as m from customer join nation on c_nationkey = n_nationkey group by n_name),
        cls as (select r_name as file, string_agg(n_name || ':' || coalesce(m, ''), ';' order by n_name) as classes from nation join region on n_regionkey = r_regionkey left join meth on class = n_name group by r_name),
        fn as (select r_name as file, string_agg(s_name, ',' order by s_name) as functions from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name)
        select r_name as file, coalesce(classes, '') as classes, coalesce(functions, '') as functions from region left join cls on cls.file = r_name left join fn on fn.file = r_name""",
    "toplevel_anti": "select doc_id, lang from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)",
    "cascade_victims": """with recursive c as (select 'r' || n_regionkey as src, 'n' || n_nationkey as dst from nation union all select 'n' || c_nationkey, 'c' || c_custkey from customer),
        v as (select 'r2' as key union select c.dst from v join c on c.src = v.key) select key from v""",
    "graph_reachability": f"""with recursive {_E}, r as (select 's1' as key, 0 as depth union select e.dst, r.depth + 1 from r join edges e on e.src = r.key where r.depth < 3)
        select key, min(depth) as depth from r group by key""",
    "stale_sweep": f"with {_LAST} select user_id as key, 'File' as label from last where user_id % 10 <> 0 and ts < timestamp '2024-01-29 00:00:00'",
    "incremental_diff": f"""with {_LAST} select user_id::varchar as file_path,
        case when user_id % 3 <> 0 and user_id % 5 > 0 and ts <= timestamp '2024-01-29 12:00:00' then 'completed' else 'pending' end as status from last where user_id % 7 <> 0""",
    "missing_antijoin": f"with {_PATHS} select page_id, file_path from paths p where not exists (select 1 from paths q where q.page_id % 2 = 0 and q.file_path = p.file_path)",
    "prefix_semijoin": f"""with {_PATHS}, f as (select distinct regexp_extract(file_path, '^([^/]+)/', 1) as folder from paths where page_id % 5 = 0)
        select file_path, page_id from paths p where exists (select 1 from f where folder <> '' and (p.file_path = folder or starts_with(p.file_path, folder || '/')))""",
    "excluded_dirs": f"""with {_PATHS}, f as (select distinct regexp_extract(file_path, '^([^/]+/[^/]+)/', 1) as folder from paths where page_id % 5 = 0 union select file_path from paths where page_id % 7 = 0)
        select file_path, page_id from paths p where not exists (select 1 from f where folder <> '' and (p.file_path = folder or starts_with(p.file_path, folder || '/')))""",
    "resolve_by_path": "select c_custkey::varchar as id, '/srv/./' || c_mktsegment || '/../' || c_name as local_path from customer where c_name = (select c_name from customer where c_custkey = 7)",
    "update_owned": """select c_custkey::varchar as id, case when c_custkey = 7 then 'new' else c_name end as description, case when c_custkey = 7 then 'github' end as git_provider,
        case when c_custkey = 7 then 'org' end as organization, case when c_custkey = 7 then 'name' end as repository_name, c_custkey = 7 as changed from customer""",
    "delete_cascade": """select 'repositories' as name, count(*) as n from customer where c_custkey <> 7 union all select 'orders', count(*) from orders where o_custkey <> 7
        union all select 'items', count(*) from lineitem join orders on l_orderkey = o_orderkey where o_custkey <> 7""",
    "delete_in_spaces": "select (count(*) + count(*) filter (where c_nationkey < 9))::bigint as deleted from customer where c_mktsegment in ('BUILDING', 'MACHINERY')",
    "auth_upsert": """with a as (select s_suppkey as k, case when s_nationkey % 2 = 0 then 'github' else 'gitlab' end as provider, s_suppkey % 3 = 0 as is_active from supplier),
        n as (select c_custkey as k, case when c_nationkey % 2 = 0 then 'github' else 'gitlab' end as provider from customer)
        select k::varchar as id, 'u' || k as user_id, provider, is_active, is_active and exists (select 1 from n where n.k = a.k and n.provider = a.provider) as touched from a union all
        select k::varchar, 'u' || k, provider, true, true from n where not exists (select 1 from a where a.k = n.k and a.provider = n.provider and is_active)""",
    "heartbeat": f"with {_LAST} select user_id::varchar as repo_id, case when user_id = 7 then '2024-02-01 00:00:00' else strftime(ts, '%Y-%m-%d %H:%M:%S') end as beat from last",
    "repos_with_work": f"with {_LAST} select distinct user_id % 40 as repo_id from last where event_type in ('view', 'search')",
    "upsert_by_id": """select c_custkey, c_name, c_nationkey, case when c_custkey % 10 = 0 then 0.0::double else c_acctbal end as c_acctbal, c_mktsegment from customer union all
        select c_custkey + 10000000, c_name, c_nationkey, c_acctbal, c_mktsegment from customer where c_custkey % 100 = 1""",
    "update_by_query": """select c_custkey, case when h then 'it s new' else c_name end as c_name, c_nationkey, case when h then 1.0::double else c_acctbal end as c_acctbal, c_mktsegment
        from (select *, c_mktsegment in ('BUILDING', 'MACHINERY') and c_nationkey = 7 as h from customer)""",
    "delete_by_query": "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer where c_mktsegment <> 'BUILDING'",
    "queue_head": "select user_id, arg_min(event_id, (ts, event_id)) as event_id, arg_min(event_type, (ts, event_id)) as event_type from events where event_type in ('view', 'click') group by user_id",
    "claim_oldest": "select event_id::varchar as file_path, 'running' as status, 1 as attempts from events where event_type = 'view' order by ts, event_id::varchar limit 100",
    "events_stream_counts": "select ts::date as day, event_type, count(*) as n from events group by day, event_type",
}
