"""Queries of spans, bursts, other languages, graph updates and streams on the test tables."""

from pyspark.sql import functions as F

from codeloom.functions import braces
from codeloom.operators import graph_update, positions
from codeloom.plans.code_queries import ORACLES as CODE_ORACLES
from codeloom.plans.code_queries import _code
from codeloom.sources.scratch import scratch_folder
from codeloom.sources.tables import read_table
from codeloom.streaming import bursts, incremental


def innermost_span(spark, sf_dir):
    """Orders as spans of lines in their customer's file, events as points in their user's."""
    o, e = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "events")
    start = F.col("o_orderkey") * 37 % 900
    spans = o.select(F.col("o_custkey").alias("file"), start.alias("start_line"), (start + F.col("o_orderkey") % 151 - 1).alias("end_line"), F.col("o_orderkey").alias("key"))
    points = e.select(F.col("user_id").alias("file"), (F.col("event_id") * 13 % 1000).alias("line")).distinct()
    return positions.innermost(spans, points, ["file"]).select("file", "line", "start_line", "end_line", "key")


def _messages(events):
    """Events as messages of five clients about fifty files; every seventh takes back what its client said."""
    items = F.when(F.col("event_id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("props"), F.concat(F.lit("k"), (F.col("event_id") % 5).cast("string"))))
    return events.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 50).alias("file"), F.col("event_type").alias("client"), "event_id", items.alias("items"))


def _bursts(messages):
    return bursts.last_of_bursts(messages, "5 minutes", "1 hour", ["file", "client"], "items", order="event_id")


def _flat(found):
    return found.select("file", "client", "started", "ended", "n", F.array_join("items", ",").alias("items"))


def diagnostics_bursts(spark, sf_dir):
    return _flat(_bursts(_messages(read_table(spark, sf_dir, "events"))))


def diagnostics_merged(spark, sf_dir):
    out = bursts.merged(_bursts(_messages(read_table(spark, sf_dir, "events"))), ["file"], "client", "items")
    return out.select("file", F.array_join("items", ",").alias("items"), "n_clients")


def _stream(spark, sf_dir, name):
    """The table as a stream of its files; a pattern stands for a table that is one file, which a plain path may not be."""
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _at_the_end(stream):
    """What a stream with complete output says once all input is taken."""
    spark, folder = stream.sparkSession, scratch_folder(stream.sparkSession)
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/out")
    step = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/out")
    stream.writeStream.outputMode("complete").foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def diagnostics_stream(spark, sf_dir):
    """diagnostics_bursts as a stream."""
    return _at_the_end(_flat(_bursts(_messages(_stream(spark, sf_dir, "events")))))


def events_stream(spark, sf_dir):
    """events_stream_counts as a stream."""
    return _at_the_end(incremental.counts_by_day(_stream(spark, sf_dir, "events")))


#: A file in each language for each row of ``part``: brackets in comments and strings, overloads, nested types.
SOURCES = {
    "j@K@.java": """package p@A@;

/** Holds { @NAME@. */
public class J@K@ extends B@B@ implements I {
    private int size = @SIZE@, other;
    String s = "} // @BRAND@";
    int add(int x) { return x; }
    /* { */
    static <T> T add(java.util.List<T> xs, int... rest)
    {
        return xs.get(0);
    }
    enum E { A, B }
}
""",
    "g@K@.go": """package g@A@

type S@K@ struct {
	ID, Size int
	Data *bytes.Buffer // {
}

func (s *S@K@) Get(a, b int) (string, error) {
	return `}`, nil
}
""",
    "s@K@.js": """export class K@K@ extends Base {
  run(a, b) { return `${a}}` + /[{]/.source }
}
function go@K@(x) {}
""",
    "x@K@.cpp": """#define OPEN {
namespace n@A@ {
class X@K@ { public: int f(int a) const { return a; } int v_; };
}
int n@A@::X@K@::g(char c) { return '}'; }
""",
}


def other_symbols(spark, sf_dir):
    k = F.col("p_partkey")
    values = {"@NAME@": F.col("p_name"), "@BRAND@": F.col("p_brand"), "@SIZE@": F.col("p_size"), "@A@": k % 7, "@B@": k % 5, "@K@": k}
    pair = F.explode(F.array(*[F.struct(F.lit(path).alias("path"), F.lit(text).alias("content")) for path, text in SOURCES.items()])).alias("f")
    files = read_table(spark, sf_dir, "part").select("*", pair)
    for mark, value in values.items():
        files = files.withColumn("f", F.struct(*[F.replace(F.col("f")[c], F.lit(mark), value.cast("string")).alias(c) for c in ("path", "content")]))
    out = braces.symbols(files.select("f.path", "f.content").repartition(2 * spark.sparkContext.defaultParallelism, "path"))
    joined = [F.array_join(c, ",").alias(c) for c in ("params", "returns", "bases", "attributes")]
    return out.select("path", "kind", "full_name", "signature", *joined, "start_line", "end_line")


def graph_update_deps(spark, sf_dir):
    """The dependencies of python_deps, from a graph that lacked some modules, had others empty and one too many, by one update."""
    files = _code(spark, sf_dir)
    n = F.regexp_extract("path", r"m(\d+)\.py$", 1).try_cast("int")
    late, empty = F.coalesce(n % 10 == 3, F.lit(False)), F.coalesce(n % 10 == 4, F.lit(False))
    before = files.where(~late).withColumn("content", F.when(empty, "").otherwise(F.col("content")))
    extra = spark.createDataFrame([("pkg0/extra.py", "import pkg1.m1")], "path string, content string")
    change = files.where(late | empty).union(extra.withColumn("content", F.lit(None).cast("string")))
    graph = graph_update.update(graph_update.build(before.union(extra)), change)
    return graph.depends.select(F.col("path").alias("src"), "dst")


NAMES = [innermost_span, diagnostics_bursts, diagnostics_merged, diagnostics_stream, events_stream, other_symbols, graph_update_deps]
QUERIES = {f.__name__: f for f in NAMES}

_BURSTS = """m as (select ts, user_id % 50 as file, event_type as client, event_id, case when event_id % 7 = 0 then [] else [props, 'k' || event_id % 5] end as items from events),
    g as (select *, sum(new) over (partition by file, client order by ts, event_id) as burst from (
      select *, case when ts <= lag(ts) over (partition by file, client order by ts, event_id) + interval 5 minutes then 0 else 1 end as new from m)),
    b as (select file, client, min(ts) as started, max(ts) as ended, count(*) as n, arg_max(items, (ts, event_id)) as items from g group by file, client, burst)"""
_BURST_ROWS = f"with {_BURSTS} select file, client, started, ended, n, array_to_string(items, ',') as items from b"

ORACLES = {
    "innermost_span": """with s as (select o_custkey as file, o_orderkey * 37 % 900 as start_line, o_orderkey * 37 % 900 + o_orderkey % 151 - 1 as end_line, o_orderkey as key from orders),
        p as (select distinct user_id as file, event_id * 13 % 1000 as line from events)
        select p.file, p.line, s.start_line, s.end_line, s.key from p join s on s.file = p.file and s.start_line <= p.line and p.line <= s.end_line
        qualify row_number() over (partition by p.file, p.line order by s.start_line desc, s.end_line, s.key) = 1""",
    "diagnostics_bursts": _BURST_ROWS,
    "diagnostics_stream": _BURST_ROWS,
    "diagnostics_merged": f"""with {_BURSTS}, l as (select file, client, arg_max(items, ended) as items from b group by file, client),
        i as (select distinct file, unnest(items) as item from l)
        select l.file, coalesce((select string_agg(item, ',' order by item) from i where i.file = l.file), '') as items, count(*) as n_clients from l group by l.file""",
    "events_stream": "select ts::date as day, event_type, count(*) as n from events group by day, event_type",
    "graph_update_deps": CODE_ORACLES["python_deps"],
    "other_symbols": """with p as (select p_partkey as k, p_partkey % 7 as a, p_partkey % 5 as b from part)
        select path, kind, full_name, signature, params, returns, bases, attributes, start_line, end_line from p, lateral (values
          ('j' || k || '.java', 'class', 'p' || a || '.J' || k, 'J' || k, '', '', 'B' || b || ',I', 'size,other,s', 4, 14),
          ('j' || k || '.java', 'method', 'p' || a || '.J' || k || '.add', 'add(int) -> int', 'x', 'int', '', '', 7, 7),
          ('j' || k || '.java', 'method', 'p' || a || '.J' || k || '.add', 'add(java.util.List, int) -> T', 'xs,rest', 'T', '', '', 9, 12),
          ('j' || k || '.java', 'enum', 'p' || a || '.J' || k || '.E', 'E', '', '', '', 'A,B', 13, 13),
          ('g' || k || '.go', 'struct', 'g' || a || '.S' || k, 'S' || k, '', '', '', 'ID:int,Size:int,Data:*bytes.Buffer', 3, 6),
          ('g' || k || '.go', 'method', 'g' || a || '.S' || k || '.Get', 'Get(int, int) -> string', 'a,b', 'string,error', '', '', 8, 10),
          ('s' || k || '.js', 'class', 'K' || k, 'K' || k, '', '', 'Base', '', 1, 3),
          ('s' || k || '.js', 'method', 'K' || k || '.run', 'run(Any, Any) -> void', 'a,b', 'void', '', '', 2, 2),
          ('s' || k || '.js', 'function', 'go' || k, 'go' || k || '(Any) -> void', 'x', 'void', '', '', 4, 4),
          ('x' || k || '.cpp', 'class', 'n' || a || '.X' || k, 'X' || k, '', '', '', 'v_', 3, 3),
          ('x' || k || '.cpp', 'method', 'n' || a || '.X' || k || '.f', 'f(int) -> int', 'a', 'int', '', '', 3, 3),
          ('x' || k || '.cpp', 'method', 'n' || a || '.X' || k || '.g', 'g(char) -> int', 'c', 'int', '', '', 5, 5)) t(path, kind, full_name, signature, params, returns, bases, attributes, start_line, end_line)""",
}
