"""The graph after random edits against one built anew."""

import random

import pytest

from codeloom.operators import graph_update as gu
from codeloom.operators.store import Store
from codeloom.streaming import incremental

KIND = "path string, content string"


def module(rng, names):
    lines = [f"from {rng.choice(names)} import {rng.choice(['f', 'C', '*', 'm1', 'm2'])}" if rng.random() < 0.7 else f"import {rng.choice(names)}" for _ in range(rng.randrange(3))]
    return "\n".join([*lines, f"def f(x):\n    return g{rng.randrange(3)}(x)" if rng.random() < 0.6 else "class C(Base):\n    def m(self):\n        return self.n()"])


def paths():
    return [f"p{i}/{n}.py" for i in range(3) for n in ("__init__", "m1", "m2", "m3")]


NAMES = [f"p{i}" for i in range(3)] + [f"p{i}.m{j}" for i in range(3) for j in range(1, 4)] + ["os"]


def state(graph):
    return (
        {r.path for r in graph.files.collect()},
        sorted(tuple(r) for r in graph.edges().collect()),
        sorted((r.path, r.full_name, r.start_line) for r in graph.symbols.collect()),
        sorted((r.path, r.pos, r.target) for r in graph.imports.collect()),
    )


@pytest.mark.parametrize("seed", [0, 1])
def test_random_edits(spark, seed):
    rng = random.Random(seed)
    files = {p: module(rng, NAMES) for p in rng.sample(paths(), 9)}
    frame = lambda d: spark.createDataFrame(list(d.items()), KIND)
    graph = gu.build(frame(files))
    for _ in range(3):
        change = {p: None if p in files and rng.random() < 0.3 else module(rng, NAMES) for p in rng.sample(paths(), rng.randrange(1, 3))}
        graph = gu.update(graph, frame(change))
        files = {p: c for p, c in (files | change).items() if c is not None}
        assert state(graph) == state(gu.build(frame(files)))


def test_work_follows_the_change(spark):
    files = {f"a{i}/m.py": f"import a{i + 1}.m\ndef f(): pass" for i in range(30)} | {f"a{i}/__init__.py": "" for i in range(30)}
    graph = gu.build(spark.createDataFrame(list(files.items()), KIND))
    change = spark.createDataFrame([("a7/m.py", "import a9.m"), ("notes.txt", "import a1"), ("a7/m.py", None)], KIND)
    d = gu.delta(graph, change)
    assert {r.path for r in d.changed.collect()} == {"a7/m.py"} and {r.path for r in d.affected.collect()} == {"a7/m.py", "a6/m.py"}
    assert {(r.path, r.dst) for r in d.new.depends.where("path = 'a7/m.py'").collect()} == {("a7/m.py", "a9/m.py"), ("a7/m.py", "a9/__init__.py")}


def test_stored_graph_as_a_stream(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    gu.create(store)
    steps = [
        {"a/__init__.py": "from .m import f", "a/m.py": "def f(): pass", "b/use.py": "from a import f", "c/alone.py": "x = 1"},
        {"a/__init__.py": "from .n import f", "a/n.py": "def f(): pass"},
        {"b/use.py": None},
    ]
    files, parts = {}, []
    for k, step in enumerate(steps):
        spark.createDataFrame(list(step.items()), KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        gu.keep_graph(incremental.changed_files(spark, f"{tmp_path}/in", KIND), store, f"{tmp_path}/cp").awaitTermination()
        files = {p: c for p, c in (files | step).items() if c is not None}
        assert state(gu.stored(store)) == state(gu.build(spark.createDataFrame(list(files.items()), KIND))), k
        parts.append({t: store.version(t).parts for t in gu.TABLES})
    from codeloom.operators.store import part_of

    assert all(parts[0][t].get(part_of("c")) == parts[2][t].get(part_of("c")) for t in gu.TABLES)
    assert parts[0]["depends"][part_of("b")] != parts[1]["depends"][part_of("b")] and parts[0]["symbols"].get(part_of("b")) == parts[1]["symbols"].get(part_of("b"))


def test_every_text_is_made_once_and_changes_are_spread(spark):
    """A graph's files are not computed again for their paths, and many short changed texts are not left to one task."""
    from pyspark.sql import functions as F

    made = spark.sparkContext.accumulator(0)

    def text(k):
        made.add(1)
        return f"import a.m{k + 1}"

    numbers = spark.range(200).select(F.concat(F.lit("a/m"), "id", F.lit(".py")).alias("path"), F.udf(text, "string")("id").alias("content"))
    graph = gu.build(numbers)
    assert graph.depends.count() == 199 and graph.files.count() == 200 and made.value == 200
    d = gu.delta(graph, spark.createDataFrame([(f"a/m{k}.py", "import a.m0") for k in range(100)], KIND))
    assert len(d.changed.inputFiles()) >= spark.sparkContext.defaultParallelism and d.new.depends.count() == 99


def test_a_path_without_a_name_is_no_module(spark):
    files = {".py": "x = 1", "a.py": "import os, b", "b.py": "import a"}
    graph = gu.build(spark.createDataFrame(list(files.items()), KIND))
    assert {tuple(r) for r in graph.depends.select("path", "dst").collect()} == {("a.py", "b.py"), ("b.py", "a.py")}
    d = gu.delta(graph, spark.createDataFrame([(".py", "import a")], KIND))
    assert {r.path for r in d.affected.collect()} == {".py"}
