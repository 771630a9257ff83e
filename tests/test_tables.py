import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from codeloom import schema
from codeloom.functions import embedding
from codeloom.operators import code_search, tree
from codeloom.operators import graph as g
from codeloom.operators import meta as m
from codeloom.operators import repos as r
from codeloom.operators import search as s
from codeloom.operators import store as st
from codeloom.streaming import incremental

PATHS = ["public/", "public/favicon.ico", "public/images/", "public/images/logo.png", "README.md", "src/", "src/components/", "src/components/Footer.tsx", "src/components/Header.tsx", "src/utils/", "src/utils/helper.js", ".hidden"]


def test_tree(spark):
    nodes = tree.nodes(spark.createDataFrame([(p,) for p in PATHS], "path string"))
    assert tree.rendered(tree.compact(nodes), "/").split("\n") == [
        "/", "public/D", "  images/D", "    logo.png/F", "  favicon.ico/F", "src/D", "  components/D", "    Footer.tsx/F", "    Header.tsx/F", "  utils/D", "    helper.js/F", "README.md/F",
    ]
    assert sorted(tree.rendered(tree.compressed(nodes)).split("\n")) == sorted(
        ["public/", "public/favicon.ico", "public/images/logo.png", "README.md", "src/", "src/components/", "src/components/Footer.tsx", "src/components/Header.tsx", "src/utils/helper.js"]
    )
    assert tree.rendered(tree.unix(nodes), ".").split("\n")[:7] == [".", "├── public/", "│   ├── images/", "│   │   └── logo.png", "│   └── favicon.ico", "├── src/", "│   ├── components/"]
    assert tree.as_json(nodes) == {"public": {"images": {"logo.png": "F"}, "favicon.ico": "F"}, "src": {"components": {"Footer.tsx": "F", "Header.tsx": "F"}, "utils": {"helper.js": "F"}}, "README.md": "F"}
    assert tree.rendered(tree.listed(nodes)).split("\n")[0] == "public/(D)"


def test_store(spark, tmp_path):
    store = st.Store(spark, f"file://{tmp_path}")
    assert store.create("t", "id string, n int, tags array<string>") and store.create("t", "id string")
    rows = spark.createDataFrame([("a", 1, ["x", "y", "x"]), ("b", 2, None)], "id string, n int, tags array<string>")
    for _ in range(2):
        store.upsert("t", rows, ["id"])
    assert store.read("t").count() == 2
    store.update("t", {"id": "a"}, {"remove": {"tags": "x"}, "n": 5})
    store.update("t", {"id": "b"}, {"add": {"tags": " z "}})
    got = {r.id: r for r in store.read("t").collect()}
    assert got["a"].tags == ["y", "x"] and got["a"].n == 5 and got["b"].tags == ["z"]
    store.update("t", {"exists": "tags"}, {"remove": "n"})
    assert store.read("t").where("n is null").count() == 2
    assert store.get(["t"], "a")["tags"] == ["y", "x"] and store.get(["t"], "q") is None and store.get(["t", "t"], "a") is None
    with pytest.raises(ValueError):
        store.delete("t", {"id": []})
    assert store.delete("t", {"id": ["a", "q"]}) == 1 and store.read("t").count() == 1
    assert store.drop("t") and not store.exists("t") and store.drop("t")


def test_search(spark):
    docs = spark.createDataFrame(
        [("1", "red fox runs. blue sky", [1.0, 0.0], ["a", "a", "b"], 3), ("2", "red sky", [0.0, 1.0], ["b"], None), ("3", "nothing here", [0.6, 0.8], None, 1)],
        "id string, text string, vec array<double>, tags array<string>, n int",
    )
    hits = lambda **k: [r.id for r in s.search([docs], s.SearchRequest(**k)).hits.collect()]
    assert hits(match=(s.MatchText(("text",), "red fox"),)) == ["1", "2"]
    assert hits(match=(s.MatchText(("text^2",), "red fox", 1.0),)) == ["1"]
    assert hits(match=(s.MatchDense("vec", (0.0, 1.0), 2),)) == ["2", "3"]
    assert hits(match=(s.MatchDense("vec", (0.0, 1.0), 1),), fill=True) == ["2", "1", "3"]
    assert hits(condition={"tags": ["a"]}) == ["1"] and hits(condition={"tags": "b", "n": 0}) == ["1", "2"]
    assert hits(order_by=(s.SortField("n"),)) == ["3", "1", "2"] and hits(order_by=(s.SortField("n", False),), offset=1) == ["3", "2"]
    assert hits(order_by=(s.SortField("absent"),), limit=0) == ["1", "2", "3"]
    result = s.search([docs, docs.drop("vec")], s.SearchRequest(match=(s.MatchText(("text",), "fox"),), highlight=("text",), select=("text",), aggs=("tags",)))
    assert result.total() == 2 and result.hits.first().text_highlight == "red <em>fox</em> runs"
    assert [tuple(r) for r in result.aggs["tags"].collect()] == [("a", 2), ("b", 2)]
    with pytest.raises(TypeError):
        hits(condition={"n": 1.5})
    assert s.rewrite_sql("select  `a` from t where x_tks like '%big cat%'") == "select a from t where match_tks(x_tks, 'big cat', 0.3)"


def stamp(day):
    return dt.datetime(2024, 1, day)


def test_graph(spark):
    nodes = spark.createDataFrame(
        [("r", "File", "a", stamp(1)), ("r", "Class", "a.C", stamp(1)), ("r", "Function", "a.C.f", stamp(2)), ("r", "Project", "r", stamp(1)), ("r", "File", "b", None)],
        "repo_id string, label string, key string, updated_at timestamp",
    )
    edge = lambda t, a, b: ("r", t, "x", a, "x", b, stamp(1))
    edges = spark.createDataFrame([edge("CONTAINS", "a", "a.C"), edge("CONTAINS", "a.C", "a.C.f"), edge("DEPENDS_ON", "b", "a"), edge("DEPENDS_ON", "a", "a")], schema.TABLES["graph_edges"])
    keys = lambda df, c="key": sorted(r[c] for r in df.collect())
    assert keys(g.dependents(edges, "a")) == ["b"] and keys(g.dependencies(edges, "b")) == ["a"]
    contains = edges.where("type = 'CONTAINS'").select(F.col("src_key").alias("src"), F.col("dst_key").alias("dst"))
    victims = g.closure(spark.createDataFrame([("a",)], "key string"), contains)
    assert keys(victims) == ["a", "a.C", "a.C.f"]
    left, edges_left = g.without(nodes, edges, victims)
    assert keys(left) == ["b", "r"] and edges_left.count() == 0
    assert keys(g.stale(nodes, F.lit(stamp(2)))) == ["a", "a.C"]
    path = F.col("p")
    folders = spark.createDataFrame([("src",), ("src/x",), ("src2/y",)], "p string")
    assert keys(folders.where(g.under_folder(path, "src")), "p") == ["src", "src/x"]
    new = spark.createDataFrame([("r", "File", "a", "A2", stamp(5), stamp(5))], "repo_id string, label string, key string, name string, created_at timestamp, updated_at timestamp")
    old = spark.createDataFrame([("r", "File", "a", "A", stamp(1), stamp(1))], new.schema)
    row = g.upsert_nodes(old, new).first()
    assert (row.name, row.created_at, row.updated_at) == ("A2", stamp(1), stamp(5))
    bases = spark.createDataFrame([("r", "X", "I"), ("r", "X", "B")], "repo_id string, src_key string, dst_key string")
    kinds = spark.createDataFrame([("r", "Class", "I", "interface")], "repo_id string, label string, key string, node_type string")
    assert {r.dst_key: r.type for r in g.inheritance_edges(bases, kinds).collect()} == {"I": "IMPLEMENTS", "B": "INHERITS"}
    stubs = g.stub_endpoints(nodes, spark.createDataFrame([("r", "CALLS", "Function", "a.C.f", "Function", "m.g", stamp(1))], schema.TABLES["graph_edges"]), "Function", "api").collect()
    assert [(r.key, r.name, r.node_type) for r in stubs] == [("m.g", "g", "api")]


def test_closure_at_any_depth(spark):
    """A chain of 20 edges whose last node leads back to the first."""
    contains = spark.createDataFrame([(f"n{i}", f"n{(i + 1) % 21}") for i in range(21)] + [("x", "y")], "src string, dst string").coalesce(1)
    start = spark.createDataFrame([("n0",)], "key string")
    assert {r.key for r in g.closure(start, contains).collect()} == {f"n{i}" for i in range(21)}
    assert {(r.key, r.depth) for r in g.reachable(contains, start, 2).collect()} == {("n0", 0), ("n1", 1), ("n2", 2)}


def test_states(spark):
    cols = schema.TABLES["file_state"]
    row = lambda path, status, done, updated, attempts=1: ("r", path, status, attempts, None, None, done, stamp(1), updated)
    states = spark.createDataFrame([row("same", "completed", stamp(5), stamp(5)), row("changed", "completed", stamp(5), stamp(5)), row("gone", "failed", None, stamp(2)), row("bad", "failed", None, stamp(3), 5)], cols)
    scan = spark.createDataFrame([("r", "same", stamp(4)), ("r", "changed", stamp(6)), ("r", "new", stamp(1)), ("r", "bad", stamp(1))], "repo_id string, file_path string, mtime timestamp")
    now = F.lit(stamp(9))
    out = m.diff(states, scan, now)
    assert {r.file_path: r.status for r in out.collect()} == {"same": "completed", "changed": "pending", "new": "pending", "bad": "pending"}
    claimed = m.claim(states, 5, now)
    assert {r.file_path for r in claimed.where("status = 'running'").collect()} == {"gone"}
    results = spark.createDataFrame([("r", "gone", True, None), ("r", "bad", False, "x")], "repo_id string, file_path string, ok boolean, error string")
    done = {r.file_path: r for r in m.finish(claimed, results, now).collect()}
    assert done["gone"].status == "completed" and done["gone"].last_finished_at == stamp(9) and done["bad"].last_error == "x"
    assert m.status_summary(states).first().asDict() == {"pending": 0, "running": 0, "completed": 2, "failed": 2, "skipped": 0, "total": 4}
    tasks = spark.createDataFrame([], schema.TABLES["analysis_tasks"])
    one = m.may_start(tasks, "r", now)
    assert [r.scan_status for r in one.collect()] == ["running"] and m.may_start(one, "r", now).count() == 1
    repos = spark.createDataFrame([("1", "Ab", None, stamp(1)), ("2", "x", "has ab", stamp(2)), ("3", "y", "z", stamp(3))], "id string, repository_name string, description string, created_at timestamp").withColumn("organization", F.lit(None).cast("string"))
    total, page = m.list_repositories(repos, "AB", 1, 1)
    assert total.count() == 2 and page.first().id == "2"
    assert m.register_repositories(repos, repos.limit(2), ["repository_name", "organization"]).count() == 3
    files = spark.createDataFrame([("a/b/c",), ("a2/b",)], "file_path string")
    assert [r.file_path for r in m.under_any(files, spark.createDataFrame([("a",)], "folder string")).collect()] == ["a/b/c"]


def test_stream_equals_batch(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    query = incremental.counts_by_day(stream).writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("days").collect()} == {tuple(r) for r in incremental.counts_by_day(events).collect()}


def test_incremental_replaces_scopes(spark, tmp_path):
    store = st.Store(spark, f"file://{tmp_path}/store")
    store.create("chunks", "file_path string, line string")
    kind = "file_path string, content string"
    analyse = lambda batch: batch.select("file_path", F.explode(F.split("content", "\n")).alias("line")).where("line <> ''")
    for rows in ([("a", "1\n2"), ("b", "3")], [("a", "")]):
        spark.createDataFrame(rows, kind).write.mode("append").parquet(f"{tmp_path}/in")
        source = incremental.changed_files(spark, f"{tmp_path}/in", kind)
        incremental.keep_current(source, store, "chunks", ["file_path"], analyse, f"{tmp_path}/cp").awaitTermination()
    assert [(r.file_path, r.line) for r in store.read("chunks").collect()] == [("b", "3")]


def test_upsert_of_odd_keys(spark):
    kind = "id string, n int"
    current = spark.createDataFrame([("a", 0), ("b", 0), (None, 7)], kind)
    new = spark.createDataFrame([(None, 1), (None, 2), ("a", 1), ("a", 2), ("c", 3)], kind)
    assert sorted((r.id or "", r.n) for r in st.upsert(current, new, ["id"], "n").collect()) == [("", 7), ("a", 2), ("b", 0), ("c", 3)]
    assert st.failed(new, ["id"]).count() == 2 and st.upsert(current, new, ["id"]).count() == 4


def test_owners_and_cancelled_scans(spark):
    repos = spark.createDataFrame([("1", "u", "/srv/a/../b"), ("2", "v", None)], "id string, user_id string, local_path string").withColumn("description", F.lit("old")).withColumn("updated_at", F.lit(stamp(1)))
    assert r.resolve(repos, path="srv/./b").first().id == "1" and r.resolve(repos, "2", "srv/b").first().id == "2" and r.resolve(repos).isEmpty()
    assert r.exists(repos, "1") and not r.exists(repos, "9")
    out = {x.id: x for x in r.update_repository(repos, "1", "u", F.lit(stamp(9)), description="new").collect()}
    assert out["1"].description == "new" and out["1"].updated_at == stamp(9) and out["2"].description == "old"
    with pytest.raises(PermissionError):
        r.update_repository(repos, "1", "v", F.lit(stamp(9)))
    with pytest.raises(LookupError):
        r.delete_repository(repos, {}, "9", "u")
    left, tables = r.delete_repository(repos, {"t": spark.createDataFrame([("1",), ("2",), (None,)], "repo_id string")}, "1", "u")
    assert [x.id for x in left.collect()] == ["2"] and tables["t"].count() == 2
    auths = spark.createDataFrame([("1", "u", "github", True, stamp(1), stamp(1))], "id string, user_id string, provider string, is_active boolean, created_at timestamp, updated_at timestamp")
    new = spark.createDataFrame([("2", "u", "github"), ("3", "u", "gitlab")], "id string, user_id string, provider string")
    saved = r.save_auth(auths, new, F.lit(stamp(9)))
    assert {x.id: x.updated_at for x in r.auths_of(saved, "u").collect()} == {"1": stamp(9), "3": stamp(9)} and r.auths_of(saved, "u", "gitlab").count() == 1
    stay, gone = r.delete_auth(saved, "u", "github")
    assert gone and stay.count() == 1 and not r.delete_auth(stay, "u", "github")[1]
    tasks = spark.createDataFrame([("1", "running", stamp(1)), ("2", "idle", stamp(1))], "repo_id string, scan_status string, scan_heartbeat_at timestamp")
    assert {x.repo_id: x.scan_heartbeat_at for x in r.heartbeat(tasks, "1", F.lit(stamp(5))).collect()} == {"1": stamp(5), "2": stamp(1)}
    r.check_running(tasks, "1")
    for repo in ("2", "9"):
        with pytest.raises(r.ScanCancelled):
            r.check_running(tasks, repo)
    states = spark.createDataFrame([("s1", "a"), ("s2", "b")], "id string, file_path string")
    assert r.work_item(states, "s2").first().file_path == "b"


def test_search_requests(spark):
    for bad in (0, 101, True, 2.5):
        with pytest.raises(ValueError):
            code_search.checked("x", bad)
    for blank in ("", " ", None, ["", " "]):
        with pytest.raises(ValueError):
            code_search.checked(blank)
    assert code_search.checked([" a ", "", "b"], 100) == ["a", "b"]
    texts = ["def read the file", "open a socket", "close the file"]
    rows = spark.createDataFrame([(f"c{i}", "r", "line_chunk_vector", f"f{i}", 1, 5, t) for i, t in enumerate(texts)], "id string, repo_id string, analysis_type string, file_path string, start_line int, end_line int, content string")
    space = embedding.embed(rows, "content")
    assert [x.file_path for x in code_search.similar_code(space, "r", "open a socket", 1).collect()] == ["f1"]
    symbols = space.withColumn("analysis_type", F.lit("symbol_summary_vector"))
    got = code_search.related_files(symbols, space, "r", ["close the file", "def read the file"], 2).collect()
    assert {x.file_path for x in got} == {"f0", "f2"} and {x.src for x in got} == {0}
    hits = s.search([space.withColumn("available_int", F.lit(1)).withColumn("none", F.lit(None).cast("string"))], s.SearchRequest(limit=1)).hits
    assert {"id", "_score"} <= set(s.sources(hits).columns)
    assert s.shaped_fields(hits, ["file_path", "start_line", "available_int", "none", "absent"]).first().fields == '{"file_path":"f0","start_line":"1","available_int":1}'
    assert s.shaped_fields(hits, ["none"]).isEmpty() and s.shaped_fields(hits, []).isEmpty()
    assert s.rewrite_sql("where x_tks = 'Big-Cat'", lambda v: v.replace("-", " "), str.lower) == "where match_tks(x_tks, 'big cat', 0.3)"


def test_scratch_folder_is_shared(spark, tmp_path):
    from types import SimpleNamespace as Fake

    from codeloom.sources import scratch

    conf = lambda folder: Fake(get=lambda key, default: folder)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_root(Fake(conf=conf(None), sparkContext=Fake(master="spark://host:7077", applicationId="x")))
    assert scratch.scratch_root(Fake(conf=conf("/shared/"), sparkContext=Fake(master="spark://host:7077", applicationId="x"))) == "/shared"
    table = scratch.materialize(spark.range(3), "t")
    assert table.count() == 3
    scratch.discard(table, None, spark.range(1))
    assert not os.path.exists(table.scratch_path.removeprefix("file://"))


REPO = "id string, user_id string, git_provider string, repository_url string, organization string, repository_name string, description string, branch string, local_path string, is_cloned boolean, created_at timestamp, updated_at timestamp"


def test_registration(spark):
    repos, now = spark.createDataFrame([], REPO), F.lit(stamp(3))
    repos = r.register(repos, "1", "u", now, url=" https://github.com/org/name.git ", description="d", branch="dev")
    repos = r.register(repos, "2", "u", now, name="pack", package="pack.zip")
    repos = r.register(repos, "3", "u", now, name="local", path="/srv/local")
    repos = r.register(repos, "4", "v", now, name="local", path="/srv/local", url="git@gitlab.com:g/p.git")
    got = {x.id: (x.git_provider, x.organization, x.repository_name, x.branch, x.local_path, x.repository_url) for x in repos.collect()}
    assert got == {
        "1": ("github", "org", "name", "dev", "/data/repos/org/name", "https://github.com/org/name.git"), "2": ("uploaded", "uploaded", "pack", "main", "/data/repos/uploads/u/pack", ""),
        "3": ("local", "local", "local", "main", "/srv/local", ""), "4": ("gitlab", "g", "local", "main", "/srv/local", "git@gitlab.com:g/p.git"),
    }
    for bad in ({"url": "https://github.com/org/name"}, {"name": "pack", "package": "p.tar"}, {"name": "local", "path": "/x"}, {"url": "ftp://x"}, {"package": "p.zip"}, {}, {"name": "n", "package": "p", "path": "/x"}):
        with pytest.raises(ValueError):
            r.register(repos, "9", "u", now, **bad)


def test_calls_name_what_they_call(spark):
    nodes = spark.createDataFrame([("r", "Function", "m.f", "f", "f(int) -> int", "function", "m.f", stamp(1), stamp(1)), ("r", "Class", "m.C", "C", None, "class", "m.C", stamp(1), stamp(1))], "repo_id string, label string, key string, name string, signature string, node_type string, full_name string, created_at timestamp, updated_at timestamp")
    calls = spark.createDataFrame([("r", "m.f", "f", "f(Any)"), ("r", "m.f", "f", "f(int)"), ("r", "os.path.join", "join", "join(str, str)"), ("r", None, "x", "x()")], "repo_id string, dst_key string, name string, signature string")
    got = {x.key: x for x in g.called(nodes, calls, F.lit(stamp(5))).collect()}
    assert got["m.f"].signature == "f(int)" and got["m.f"].node_type == "function" and got["m.f"].created_at == stamp(1) and got["m.f"].updated_at == stamp(5)
    assert got["os.path.join"].node_type == "api" and got["os.path.join"].name == "join" and got["m.C"].updated_at == stamp(1) and len(got) == 3


def test_catalogue_without_ignored_names(spark, tmp_path):
    from codeloom.sources import repo_files as rf

    for path in ("src/a.py", "src/gen/b.py", "Build/c.py", "d_test.py", "e.py"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x")
    listed = lambda: {(x.path, x.is_dir) for x in rf.catalogue(spark, str(tmp_path)).collect()}
    assert len(listed()) == 5 + 3
    (tmp_path / ".gitignore").write_text("# c\n\nbuild/\n*_test.py\ngen\ne.py/\n")
    assert listed() == {("src", True), ("src/a.py", False), ("e.py", False)}
