"""Symbols of other languages: goldens, odd files, and files that break off anywhere."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.functions import braces, embedding, other_code

JAVA = r'''package a.b; // class Fake {}
import x.Y;
/** A doc. */
@Ann(value = "{", n = {1, 2})
public class Outer<T extends Comparable<T>> extends Base implements I, K {
    private static final Map<String, List<Integer>> MAP = new HashMap<>() {{ put("a{", null); }};
    int a, b[] = {1, 2}, c;
    Outer(int x) { this.a = x; }
    /** Sums. */
    @Override
    int add(int x, final List<String> names, String... rest) throws E {
        String s = "}"; char c = '{'; /* } */
        Runnable r = () -> { run(); };
        return new Object() { int hidden() { return 1; } }.hidden();
    }
    public int add(int x) { return x; }
    abstract void nothing();
    <R> Map<String, R> generic(R r) { return null; }
    static class Inner { String name; String get() { return """
       } text " block
       """; } }
    enum Color { RED("r") { void f() {} }, GREEN, @Deprecated BLUE; final String s; String low() { return s; } }
    record Point(int x, int y) { int sum() { return x + y; } }
    interface Shape { double area(); default void draw() {} }
    void _hidden() {}
    static { init(); }
}
'''

GO = r'''package main

import "fmt"

// Server serves.
type Server struct {
	ID, Other int
	Data *bytes.Buffer `json:"data{"`
	sync.Mutex
	m map[string]func(int) error
}
type (
	Reader interface {
		Read(p []byte) (n int, err error)
		Close() error
		fmt.Stringer
	}
	Alias = int
)
func (s *Server) Run(ctx context.Context, a, b int) (string, error) {
	x := `raw } `
	return "", nil
}
func Map[T any](xs []T, f func(T) T) []T { return xs }
func plain() {}
func _skip() {}
func (l List[T]) Len() int { return 0 }
func multi(
	a string,
) error {
	return nil
}
'''

JAVASCRIPT = r'''import x from './a'
// function no() {}
export default class Foo extends Bar.Baz {
  static count = 0
  #p = { a: 1 }
  constructor(a, {b, c} = {}, ...rest) { super(a) }
  async *gen() { yield `t ${ `${1}` + "}" } }` }
  get size() { return /[/}{]/.test(x) ? 1 : 2 }
  _hidden() {}
  handler = () => { function inner() {} }
}
async function load(url, opts = {}) { return fetch(url) }
export function* walk(tree) { yield 1 }
const f = function named() {}
function _no() {}
if (a) { function deep(x) { return x / 2 / 3 } }
const s = "function fake() {}"
'''

C = r'''#include "a.h"
#define M(x) { \
  x }
typedef struct { int a; char *name; } Pair;
struct node { struct node *next; int v[10], w; };
enum color { RED, GREEN = 2 };
static const char *find(const char *key, size_t n, void (*cb)(int)) { return "}"; }
int main(void) { if (x) { y(); } return 0; }
unsigned int proto(int);
int arr[] = { 1, 2 };
'''

CPP = r'''namespace n { namespace m {
template <typename T, class U = std::vector<T>>
class Box : public Base<T>, private Other {
public:
  Box(int x) : x_(x), y_{1} {}
  ~Box();
  virtual int get(const std::string& s, int n = 3) const override { return n; }
  int get() const;
  bool operator==(const Box& o) const { return true; }
private:
  int x_, y_;
  std::map<int, std::string> m_;
};
enum class E { A, B };
auto f(int a) -> std::string { return R"x(} ")x"; }
}
int m::Box::get() const { return 1'000; }
}
extern "C" { void c_api(int a) { } }
'''

SAMPLES = {"java": JAVA, "go": GO, "javascript": JAVASCRIPT, "c": C, "cpp": CPP}


def found(lang):
    return {(s.kind, s.full_name, s.first, s.last): s for s in braces.read(SAMPLES[lang], lang)}


def test_java():
    got = found("java")
    assert [(k, n, a, z) for k, n, a, z in got] == [
        ("class", "a.b.Outer", 4, 27), ("method", "a.b.Outer.add", 10, 15), ("method", "a.b.Outer.add", 16, 16), ("method", "a.b.Outer.nothing", 17, 17), ("method", "a.b.Outer.generic", 18, 18),
        ("class", "a.b.Outer.Inner", 19, 21), ("method", "a.b.Outer.Inner.get", 19, 21), ("enum", "a.b.Outer.Color", 22, 22), ("method", "a.b.Outer.Color.low", 22, 22), ("record", "a.b.Outer.Point", 23, 23),
        ("method", "a.b.Outer.Point.sum", 23, 23), ("interface", "a.b.Outer.Shape", 24, 24), ("method", "a.b.Outer.Shape.area", 24, 24), ("method", "a.b.Outer.Shape.draw", 24, 24),
    ]
    outer, long, short = list(got.values())[:3]
    assert outer.attributes == ["MAP", "a", "b", "c"] and outer.bases == ["Base", "I", "K"] and outer.owner is None
    assert (long.params, long.types, long.returns, long.owner) == (["x", "names", "rest"], ["int", "List", "String"], ["int"], "Outer") and short.types == ["int"]
    assert got["record", "a.b.Outer.Point", 23, 23].attributes == ["x", "y"] and got["enum", "a.b.Outer.Color", 22, 22].attributes == ["RED", "GREEN", "BLUE", "s"]


def test_go():
    got = found("go")
    assert list(got) == [
        ("struct", "main.Server", 6, 11), ("interface", "main.Reader", 13, 17), ("method", "main.Reader.Read", 14, 14), ("method", "main.Reader.Close", 15, 15), ("method", "main.Server.Run", 20, 23),
        ("function", "main.Map", 24, 24), ("function", "main.plain", 25, 25), ("method", "main.List.Len", 27, 27), ("function", "main.multi", 28, 32),
    ]
    server, _, read, close, run, map_, *_ = got.values()
    assert server.attributes == ["ID:int", "Other:int", "Data:*bytes.Buffer", "Mutex:sync.Mutex", "m:map[string]func(int) error"]
    assert (read.params, read.types, read.returns) == (["p"], ["[]byte"], ["int", "error"]) and close.returns == ["error"]
    assert (run.params, run.types, run.returns) == (["ctx", "a", "b"], ["context.Context", "int", "int"], ["string", "error"])
    assert (map_.params, map_.types, map_.returns) == (["xs", "f"], ["[]T", "func(T) T"], ["[]T"])


def test_javascript():
    got = found("javascript")
    assert [(k, n) for k, n, _, _ in got] == [("class", "Foo"), ("method", "Foo.constructor"), ("method", "Foo.gen"), ("method", "Foo.size"), ("function", "inner"), ("function", "load"), ("function", "walk"), ("function", "deep")]
    foo, make, *_ = got.values()
    assert foo.attributes == ["count", "p", "handler"] and foo.bases == ["Bar.Baz"] and (foo.first, foo.last) == (3, 11)
    assert make.params == ["a", "{b,c}", "rest"] and got["function", "load", 12, 12].params == ["url", "opts"]


def test_c():
    got = found("c")
    assert list(got) == [("struct", "Pair", 4, 4), ("struct", "node", 5, 5), ("enum", "color", 6, 6), ("function", "find", 7, 7), ("function", "main", 8, 8), ("function", "proto", 9, 9)]
    pair, node, color, find, main, proto = got.values()
    assert pair.attributes == ["a", "name"] and node.attributes == ["next", "v", "w"] and color.attributes == ["RED", "GREEN"]
    assert find.params == ["key", "n", "cb"] and find.types[:2] == ["const char*", "size_t"] and find.returns == ["char*"]
    assert main.params == [] and proto.types == ["int"] and proto.returns == ["unsigned int"]


def test_cpp():
    got = found("cpp")
    assert [(k, n) for k, n, _, _ in got] == [
        ("class", "n.m.Box"), ("method", "n.m.Box.Box"), ("method", "n.m.Box.~Box"), ("method", "n.m.Box.get"), ("method", "n.m.Box.get"), ("method", "n.m.Box.operator=="), ("enum", "n.m.E"),
        ("function", "n.m.f"), ("method", "n.m.Box.get"), ("function", "c_api"),
    ]
    box, _, _, get, *_ = got.values()
    assert box.attributes == ["x_", "y_", "m_"] and box.bases == ["Base", "Other"] and (box.first, box.last) == (2, 13)
    assert (get.params, get.types, get.returns) == (["s", "n"], ["const std::string&", "int"], ["int"])


@pytest.mark.parametrize("lang", SAMPLES)
def test_files_that_break_off(lang):
    """Any beginning of a file is read, and so is any file without its first characters."""
    text = SAMPLES[lang]
    for i in range(0, len(text), 3):
        for part in (text[:i], text[i:]):
            for s in braces.read(part, lang):
                assert 0 <= s.start < s.end <= len(part) and 1 <= s.first <= s.last <= part.count("\n") + 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("class struct interface enum record func type function ( ) { } [ ] < > , ; : :: = -> \" ' ` / // /* */ a B int void operator @ ~ * & . \n #".split(" ")), max_size=40), st.sampled_from(sorted(SAMPLES)))
def test_any_tokens(parts, lang):
    for text in (" ".join(parts), "".join(parts)):
        braces.read(text, lang)


def test_long_files_take_time_in_proportion():
    import time

    for lang, text in SAMPLES.items():
        started = time.time()
        assert len(braces.read(text * 100, lang)) >= 100 * len(found(lang)) - 100
        assert time.time() - started < 8


def test_tables_of_files(spark):
    rows = [("x/A.java", JAVA), ("b.go", GO), ("c.MJS", JAVASCRIPT), ("d.c", C), ("e.cpp", CPP), ("f.py", "class Py: pass"), ("g.java", None), ("h.go", ""), (None, "class A {}")]
    files = spark.createDataFrame(rows, "path string, content string")
    got = braces.symbols(files).collect()
    assert len(got) == sum(len(found(lang)) for lang in SAMPLES) and {r.path for r in got} == {r[0] for r in rows[:5]}
    by = {r.signature: r for r in got}
    assert by["add(int, List, String) -> int"].docstring == "Sums." and by["add(int) -> int"].source == "public int add(int x) { return x; }"
    assert by["Server"].docstring == "Server serves." and by["Run(context.Context, int, int) -> string"].class_name == "Server"
    assert embedding.symbol_summaries(braces.symbols(files), "r").count() > 10
    assert {(r.kind, r.name) for r in other_code.declarations(files.where("path = 'd.c'"), "c").collect()} == {("struct", "Pair"), ("struct", "node"), ("enum", "color"), ("function", "find"), ("function", "main"), ("function", "proto")}


def test_java_modules_with_one_class_name(spark):
    rows = [
        ("one/src/main/java/a/Use.java", "import c.D;\nimport e.*;"), ("two/src/test/java/a/UseTest.java", "import c.D;\nimport e.*;"), ("three/src/main/java/a/Far.java", "import c.D;\nimport e.*;"),
        *[(f"{m}/src/main/java/{p}.java", "") for m in ("one", "two") for p in ("c/D", "e/F", "e/G")],
    ]
    files = spark.createDataFrame(rows, "path string, content string")
    got = {}
    for r in other_code.file_dependencies(files, "java").collect():
        got.setdefault(r.src.split("/")[0], set()).add(r.dst.replace("src/main/java/", ""))
    assert got["one"] == {"one/c/D.java", "one/e/F.java", "one/e/G.java"} and got["two"] == {"two/c/D.java", "two/e/F.java", "two/e/G.java"}
    assert got["three"] == {"one/c/D.java", *(f"{m}/e/{x}.java" for m in ("one", "two") for x in "FG")}
