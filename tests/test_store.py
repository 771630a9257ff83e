"""Concurrent changes, pruned rewrites and old versions of stored tables."""

import threading

import pytest

from codeloom.operators import store as st
from codeloom.streaming import incremental

KIND = "id string, repo_id string, n int"


@pytest.fixture
def store(spark, tmp_path):
    out = st.Store(spark, f"file://{tmp_path}/store")
    out.create("t", KIND)
    out.write("t", spark.createDataFrame([(f"{r}{i}", r, i) for r in "abc" for i in range(3)], KIND))
    return out


def rows(store, **k):
    return sorted((r.id, r.n) for r in store.read("t", **k).collect())


def between(store, other):
    """Let another change come in just before the next version is taken, once."""
    publish, pending = store._publish, [other]

    def first_the_other(name, version):
        while pending:
            pending.pop()()
        return publish(name, version)

    store._publish = first_the_other


def test_change_of_one_repository_rewrites_its_part_alone(spark, store):
    before = store.version("t")
    store.upsert("t", spark.createDataFrame([("a0", "a", 9), ("a7", "a", 7)], KIND), ["repo_id", "id"])
    after = store.version("t")
    changed = {p for p in before.parts | after.parts if before.parts.get(p) != after.parts.get(p)}
    assert changed == {st.part_of("a")} and after.number == before.number + 1
    assert rows(store, scopes=["a"]) == [("a0", 9), ("a1", 1), ("a2", 2), ("a7", 7)] and len(rows(store)) == 10
    assert store.delete("t", {"repo_id": "b", "id": ["b0", "b1", "b2"]}) == 3 and st.part_of("b") not in store.version("t").parts
    store.update("t", {"id": "c1"}, {"n": 5})
    assert {p for p in after.parts if after.parts[p] != store.version("t").parts.get(p)} == {st.part_of("b"), st.part_of("c")}
    store.update_by_id("t", "c2", {"n": 6})
    assert rows(store, scopes=["c"]) == [("c0", 0), ("c1", 5), ("c2", 6)]
    with pytest.raises(ValueError):
        store.update("t", {"id": "c1"}, {"repo_id": "a"})
    number = store.version("t").number
    store.update("t", {"id": "absent"}, {"n": 5})
    assert store.delete("t", {"id": "absent"}) == 0 and store.version("t").number == number


def test_a_row_that_moves_to_another_repository_is_there_once(spark, store):
    store.upsert("t", spark.createDataFrame([("a0", "b", 1), (None, "c", 1)], KIND), ["id"])
    assert [r.repo_id for r in store.read("t").where("id = 'a0'").collect()] == ["b"] and store.read("t").count() == 9


@pytest.mark.parametrize("key", [["id"], ["repo_id", "id"]])
@pytest.mark.parametrize("repo", ["a", "b"])
def test_two_writers_from_one_version(spark, store, key, repo):
    new = lambda *r: spark.createDataFrame([r], KIND)
    other = st.Store(spark, store.root)
    between(store, lambda: other.upsert("t", new("x", repo, 1), key))
    store.upsert("t", new("y", "a", 2), key)
    assert {"x", "y"} <= {i for i, _ in rows(store)} and len(rows(store)) == 11
    between(store, lambda: other.upsert("t", new("z", "a", 1), ["id"]))
    store.upsert("t", new("z", "b", 2), ["id"])
    assert [(r.repo_id, r.n) for r in store.read("t").where("id = 'z'").collect()] == [("b", 2)]
    between(store, lambda: other.upsert("t", new("late", "c", 1), ["id"]))
    assert store.delete("t", {"n": [0]}) == 3 and ("late", 1) in rows(store)


def test_many_writers_at_once(spark, store):
    def write(k):
        st.Store(spark, store.root).upsert("t", spark.createDataFrame([(f"w{k}", "abc"[k % 3], k)], KIND), ["repo_id", "id"])

    threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert {f"w{k}" for k in range(6)} <= {i for i, _ in rows(store)} and store.version("t").number == 7


def test_old_versions(spark, store):
    for k in range(4):
        store.upsert("t", spark.createDataFrame([("a0", "a", 10 + k)], KIND), ["repo_id", "id"])
    assert store.version("t", 2).rows().where("id = 'a0'").first().n == 10
    assert store.clean("t", keep=2) == 0
    assert store.clean("t", keep=2, age=-60) == 2 and store.clean("t", keep=2, age=-60) == 0
    assert len(rows(store)) == 9 and store.version("t", 4).rows().count() == 9
    with pytest.raises(LookupError):
        store.version("t", 1)
    with pytest.raises(LookupError):
        store.read("absent")


def test_new_columns_and_parts_without_a_scope(spark, store):
    store.upsert("t", spark.createDataFrame([("q", None, 1, "more")], KIND + ", note string"), ["id"])
    got = {r.id: r.note for r in store.read("t").collect()}
    assert got["q"] == "more" and got["a0"] is None and rows(store, scopes=[None]) == [("q", 1)]


def test_a_batch_of_changed_files_leaves_other_repositories_alone(spark, store, tmp_path):
    store.create("lines", "repo_id string, file_path string, line string")
    kind = "repo_id string, file_path string, content string"
    analyse = lambda b: b.selectExpr("repo_id", "file_path", "explode(split(content, '\n')) as line").where("line <> ''")
    seen = []
    for batch in ([("a", "x", "1\n2"), ("a", "y", "3"), ("b", "x", "4")], [("b", "x", "")], [("a", "x", "5")]):
        spark.createDataFrame(batch, kind).write.mode("append").parquet(f"{tmp_path}/in")
        source = incremental.changed_files(spark, f"{tmp_path}/in", kind)
        incremental.keep_current(source, store, "lines", ["repo_id", "file_path"], analyse, f"{tmp_path}/cp").awaitTermination()
        seen.append(store.version("lines").parts)
    assert sorted(r.line for r in store.read("lines").collect()) == ["3", "5"]
    assert set(seen[0]) == {st.part_of("a"), st.part_of("b")} and seen[1] == {st.part_of("a"): seen[0][st.part_of("a")]} and seen[2] != seen[1]
