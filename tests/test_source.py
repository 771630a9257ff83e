import subprocess

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.functions import chunks, embedding, other_code, python_code
from codeloom.sources import repo_files as rf

PY = "def add(a, b):\n    return a + b\n\ndef mul(a, b):\n    return a * b\n\nprint(mul(2, 3))\n"


def spans(text, ext=".py"):
    return [(a, b) for a, b, _ in chunks.chunk(text, ext)]


def test_chunks():
    assert spans(PY) == [(1, 5)]
    assert spans(" \n ") == [] == spans(None)
    assert spans("a = 1\nb = 2\nc = 3\nd = 4\nx = f(\n  1,\n  2)\ny = 5\nz = 6\n")[0] == (1, 7)
    assert spans("a = 1\nb = 2\nc = 3\nd = 4\nif a:\n    b = 3\n    c = 4\nz = 6\n")[0] == (1, 7)
    assert spans("a = 1\nb = 2\nc = 3\nd = 4\nx = 1 + \\\n    2\nz = 6\n")[0] == (1, 6)
    assert spans("int a;\n#include <x.h>\nint b;\n", ".c") == []


def test_chunks_at_open_ends():
    plain = "".join(f"v{i} = {i}\n" for i in range(400))
    assert spans("a = 1  # don't stop\n" + plain)[:3] == [(1, 5), (5, 9), (9, 13)]  # an open quote alone leaves nothing open
    assert spans("a = 1\nb = 2\nc = 3\nd = 4\nx = 1 + \\ \n    2\nz = 6\n")[0] == (1, 5)  # blanks after the backslash
    assert spans("a = 1\nb = 2\nc = 3\nd = 4\n# note \\\n    2\nz = 6\n")[0] == (1, 5)
    assert spans("a = 1\nb = 2\nc = 3\nd = 4\nif a:\n    b = f(\n1,\n2)\n    c = 3\nz = 6\n")[0] == (1, 8)  # a bracket that the block leaves open
    assert spans("a = 1\nb = 2\nc = 3\nd = 4\nif a:\n    if b:\n        c = 4\n\n# note\n    d = 5\nz = 6\n")[0] == (1, 10)
    assert spans("a = 1\nb = 2\nc = 3\nd = 4\nx = (1\nfor y in z:\n    w)\n    v\nu = 1\n")[0] == (1, 7)
    assert spans("a = 1\nb = 2\nc = 3\nd = 4 )\nx = (1\n2)\nz = 6\n")[0] == (1, 5)  # after a closer without an opener nothing counts
    assert spans("x = f(\n" + plain)[0] == (1, chunks.LONGEST)
    assert not chunks.unbalanced("it's ( here") and chunks.unbalanced("f('(' , (") and not chunks.unbalanced("(]") and not chunks.unbalanced("'\\'(' ")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab(){}\"':\\ #", max_size=12), max_size=60))
def test_chunks_advance(lines):
    text = "\n".join(lines)
    starts = [(a, b) for a, b, _ in chunks.chunk(text, ".py")]
    assert all(b - a < chunks.LONGEST + chunks.TARGET for a, b in starts)
    assert [a for a, _ in starts] == sorted({a for a, _ in starts})


def test_python_imports():
    read = lambda code, path="app/models/user.py": python_code.read(code, path)
    r = read("from ..utils import helper")
    assert r.names == {"helper": "app.utils.helper"} and r.imported == ["app.utils", "app.utils.helper"]
    assert read("from .base import Model").names == {"Model": "app.models.base.Model"}
    assert read("from app.config import settings as cfg").names == {"cfg": "app.config.settings"}
    assert read("import numpy as np").names == {"np": "numpy"}
    assert read("from .. import x", "m.py").imported == []
    assert read("def broken(") is None


def test_imports_of_statements_alone():
    """The same as of all nodes, in the same order, wherever a statement may stand."""
    code = """import a
if f(lambda: x):
    import b
    try:
        from c import d
    except* E:
        from .e import f as g
    else:
        import h.i
    finally:
        import j
elif y:
    import k
else:
    with w as v:
        async def f(z=[q for q in p]):
            match z:
                case [1, *_] if r:
                    import l
                case _:
                    class M(N):
                        from . import n
            for s in t:
                import o
            else:
                import u
while 1: import v.w
else: import x
"""
    tree = python_code.parsed(code)
    got = python_code.imports(python_code.statements(tree), "p/m.py")
    assert got == python_code.imports(python_code.walked(tree), "p/m.py") and len(got[1]) == 16


def test_modules_are_made_after_the_exchange(spark, sf):
    """The rows of the small table are spread, not the modules that one task would have to make of them."""
    from codeloom.plans.code_queries import _code

    below = _code(spark, sf)._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1].split("\n+- ")[0]
    assert "p_partkey" in below and "get_kind" not in below


def test_python_symbols():
    code = "from abc import ABC\nimport os\nclass A(ABC):\n    x: int = 1\n    def f(self, a: int, *b) -> str:\n        self.g()\n        os.path.join(a)\n        return 'x'\ndef g(n):\n    print(n)\n    yield A()\n"
    by = {s[2]: s for s in python_code.read(code, "p/m.py").symbols()}
    assert set(by) == {"p.m.A", "p.m.A.f", "p.m.g"}
    assert by["p.m.A"][0] == "interface" and by["p.m.A"][9] == ["x"]
    f = by["p.m.A.f"]
    assert f[4] == "f(Any, int, Any) -> str" and f[5] == ["self", "a", "*b"]
    assert ("p.m.A.g", "g()") in f[14] and ("os.path.join", "join(Any)") in f[14]
    assert "Generator" in by["p.m.g"][7] and [c for c, _ in by["p.m.g"][14]] == ["p.m.A"]


def test_python_dependencies(spark):
    files = spark.createDataFrame(
        [
            ("main.py", "from pkg import thing\nimport pkg.plain"),
            ("pkg/__init__.py", "from .a import thing\nfrom .b import other\nfrom . import sub"),
            ("pkg/a.py", "import main"), ("pkg/b.py", ""), ("pkg/plain.py", ""), ("pkg/sub/__init__.py", "from pkg import thing"),
        ],
        "path string, content string",
    )
    got = {(r.src, r.dst) for r in python_code.file_dependencies(files).collect()}
    assert {("main.py", "pkg/__init__.py"), ("main.py", "pkg/a.py"), ("main.py", "pkg/plain.py"), ("pkg/a.py", "main.py")} <= got
    assert ("main.py", "pkg/b.py") not in {x for x in got if x[0] == "main.py"} or ("main.py", "pkg/__init__.py") in got


def test_long_chains_of_exports(spark):
    """Ten packages hand a name on, and the last but one also leads back to the first."""
    rows = [("use.py", "from p0 import f\n"), ("end.py", "def f(): pass\n")]
    rows += [(f"p{i}/__init__.py", f"from p{i + 1} import f\n" if i < 9 else "from end import f\nfrom p0 import f\n") for i in range(10)]
    files = spark.createDataFrame(rows, "path string, content string")
    got = {r.dst for r in python_code.file_dependencies(files).collect() if r.src == "use.py"}
    assert got == {"end.py", *(f"p{i}/__init__.py" for i in range(10))}


def test_other_languages(spark):
    row = spark.range(1).select(other_code.imported(F.lit("import a from './a'; require('node:fs'); import('./b')"), "javascript").alias("x")).first()
    assert row.x == ["./a", "./b"]
    body = "ID int; Name string; Data *bytes.Buffer"
    assert spark.range(1).select(other_code.go_fields(F.lit(body)).alias("x")).first().x == ["ID:int", "Name:string", "Data:*bytes.Buffer"]
    c = spark.createDataFrame([("s/a.c", '#include "a.h"\n#include "b.h"\n#include <x.h>'), ("s/a.h", ""), ("b.h", "")], "path string, content string")
    assert {(r.src, r.dst) for r in other_code.file_dependencies(c, "c").collect()} == {("s/a.c", "s/a.h"), ("s/a.c", "b.h")}
    go = spark.createDataFrame([("m/a.go", 'import "ex.com/m/p"'), ("p/x.go", ""), ("p/x_test.go", "")], "path string, content string")
    assert {(r.src, r.dst) for r in other_code.file_dependencies(go, "go", "ex.com/m").collect()} == {("m/a.go", "p/x.go")}
    js = spark.createDataFrame([("w/a.js", "import x from './lib'; import y from '../z.js'"), ("w/lib/index.js", ""), ("z.js", "")], "path string, content string")
    assert {(r.src, r.dst) for r in other_code.file_dependencies(js, "javascript").collect()} == {("w/a.js", "w/lib/index.js"), ("w/a.js", "z.js")}
    java = spark.createDataFrame(
        [("src/main/java/a/B.java", "package a;\nimport c.D;\nimport e.*;\nimport f.G.Inner;\n"), ("src/main/java/c/D.java", "public class D {}"), ("src/main/java/e/H.java", ""), ("src/main/java/f/G.java", "")],
        "path string, content string",
    )
    assert {r.dst.rpartition("/")[2] for r in other_code.file_dependencies(java, "java").collect()} == {"D.java", "H.java", "G.java"}
    assert [tuple(r) for r in other_code.declarations(java, "java").collect()] == [("src/main/java/c/D.java", "class", "D")]


def test_repo_source(spark, tmp_path):
    for path, data in {"a/__init__.py": b"x = 1\xff", "a/b.go": b"", "tests/t.py": b"", ".git/c.py": b"", "n.txt": b"", "README.md": b"hi"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    rows = {r.path: r for r in rf.repo_files(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a/__init__.py", "a/b.go"} and rows["a/__init__.py"].content == "x = 1"
    assert [r.path for r in rf.repo_files(spark, str(tmp_path), target="a/b.go").collect()] == ["a/b.go"]
    assert rf.readme(str(tmp_path)) == "hi"
    git = lambda *a: subprocess.run(["git", "-C", tmp_path, "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "n.txt")
    git("commit", "-qm", "first")
    rf.register(spark)
    assert [r.message for r in spark.read.format("git_log").options(root=str(tmp_path)).load().collect()] == ["first"]


def test_records(spark):
    files = spark.createDataFrame([("a.py", "def f(x):\n    y = x + 1\n    z = y * 2\n    print(z)\n    return z\n" * 4), ("b.py", "")], "path string, content string")
    records = embedding.chunk_records(chunks.chunked(files), "r", 16).collect()
    assert records and all(len(r.vec) == 16 and r.file_path == "a.py" for r in records) and len({r.id for r in records}) == len(records)
    symbols = python_code.symbols(files.where("path = 'a.py'"))
    assert embedding.symbol_summaries(symbols, "r").count() == 4


def test_batches_without_symbols_and_null_files(spark):
    files = spark.createDataFrame([("a.py", "x = 1\n"), ("b.py", None), ("c.txt", "def f(): pass"), ("d.py", "def broken(")], "path string, content string")
    assert python_code.symbols(files.coalesce(1)).count() == 0 and python_code.import_rows(files).count() == 0
    assert [(r.path, r.start_line) for r in chunks.chunked(files.union(spark.createDataFrame([("noext", " \n"), (None, "text")], files.schema))).collect()] == [("a.py", 1), ("c.txt", 1), ("d.py", 1), (None, 1)]


def test_chunks_in_sql(spark):
    chunks.register(spark)
    got = spark.sql("select c.* from values ('a = (1,\n2)\nb') t(x), lateral chunk_lines(x, '.py') c").collect()
    assert [tuple(r) for r in got] == [(1, 3, "a = (1,\n2)\nb")]
