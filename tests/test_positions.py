"""Spans around lines, definitions and references, against looking at every span."""

import random

from pyspark.sql import functions as F

from codeloom.operators import positions as p


def test_blocks_make_up_the_span(spark):
    rng = random.Random(0)
    rows = [(0, 0), (1, 1), (0, 1023), (5, 2**30), (2**31 - 2, 2**31 - 1)] + [(a, a + rng.randrange(5000)) for a in (rng.randrange(10**6) for _ in range(60))]
    df = spark.createDataFrame(rows, "a long, b long").withColumn("blocks", p.blocks_of(F.col("a"), F.col("b")))
    for r in df.collect():
        parts = sorted((b.block << b.size, (b.block + 1) << b.size) for b in r.blocks)
        assert parts[0][0] == r.a and parts[-1][1] == r.b + 1 and all(x[1] == y[0] for x, y in zip(parts, parts[1:], strict=False)) and len(parts) <= 2 * (r.b - r.a + 1).bit_length()


def test_innermost_against_all_spans(spark):
    rng = random.Random(1)
    spans = [(f"f{rng.randrange(4)}", a, a + rng.choice([-1, 0, 3, 40, 10**7]), f"k{i}") for i, a in enumerate(rng.randrange(300) for _ in range(150))] + [("f0", None, 3, "n"), ("f0", 1, None, "n"), (None, 1, 3, "n")]
    points = [(f"f{rng.randrange(5)}", rng.randrange(330)) for _ in range(200)] + [("f1", None), (None, 2), ("f1", 2**30)]
    s = spark.createDataFrame(spans, "file_path string, start_line long, end_line long, key string")
    q = spark.createDataFrame(points, "file_path string, line long")
    want, all_ = {}, set()
    for f, x in set(points):
        hits = [(-a, b, k) for g, a, b, k in spans if None not in (f, x, g, a, b) and g == f and a <= x <= b]
        all_ |= {(f, x, k) for _, _, k in hits}
        if hits:
            want[f, x] = min(hits)[2]
    assert {(r.file_path, r.line): r.key for r in p.innermost(s, q, ["file_path"]).collect()} == want
    assert {(r.file_path, r.line, r.key) for r in p.enclosing(s, q.distinct(), ["file_path"]).collect()} == all_


def test_innermost_over_tiles_and_ties(spark):
    rng = random.Random(2)
    spans = [("f", a, a + rng.choice([0, 1, 7, 8, 60, 4000]), rng.choice([None, *range(40)])) for a in (rng.randrange(90) for _ in range(120))] * 2 + [("g", 0, 2**31 - 1, 7)]
    points = [(f, x, tag) for f in "fgh" for x in [*range(0, 200, 3), 2**31 - 1] for tag in (None, "a")] * 2
    s = spark.createDataFrame(spans, "file_path string, start_line long, end_line long, key int")
    q = spark.createDataFrame(points, "file_path string, line long, tag string")
    want = {}
    for f, x, tag in set(points):
        hits = [(-a, b, -1 if k is None else k) for g, a, b, k in spans if g == f and a <= x <= b]
        if hits:
            a, b, k = min(hits)
            want[f, x, tag] = (-a, b, None if k < 0 else k)
    for tile in (2, 3, 12):
        got = p.innermost(s, q, ["file_path"], tile=tile).collect()
        assert len(got) == len(want) and {(r.file_path, r.line, r.tag): (r.start_line, r.end_line, r.key) for r in got} == want


def shuffled_rows(spark, action):
    """How many rows an action writes to shuffles."""
    context = spark.sparkContext
    status, lists = context._jsc.sc().statusStore(), context._jvm.java.util.ArrayList
    total = lambda: sum(s.shuffleWriteRecords() for s in context._jvm.scala.jdk.javaapi.CollectionConverters.asJava(status.stageList(lists(), False, False, context._gateway.new_array(context._jvm.double, 0), lists())))
    context._jsc.sc().listenerBus().waitUntilEmpty()
    before = total()
    action()
    context._jsc.sc().listenerBus().waitUntilEmpty()
    return total() - before


def test_spans_and_points_move_a_few_times(spark):
    spans = spark.range(3000).selectExpr("id % 5 as file", "id % 100 as start_line", "id % 100 + 700 as end_line", "id as key")
    points = spark.range(2000).selectExpr("id % 5 as file", "id div 5 as line")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert shuffled_rows(spark, p.innermost(spans, points, ["file"]).collect) <= 3 * 5000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_definitions_and_references(spark):
    symbols = spark.createDataFrame([("m.f", "a.py", 1, 5), ("m.C", "a.py", 8, 30), ("m.C.g", "a.py", 10, 12), ("n.h", "b.py", 1, 9)], "key string, file_path string, start_line long, end_line long")
    uses = spark.createDataFrame([("a.py", 11, "n.h"), ("b.py", 3, "m.f"), ("b.py", 3, "m.C.g"), ("b.py", 4, "m.f"), ("b.py", 4, "m.f"), ("b.py", 5, "outside")], "file_path string, line long, dst_key string")
    at = lambda *x: spark.createDataFrame(x, "file_path string, line long")
    got = {(r.file_path, r.line, r.key, r.def_path, r.start_line) for r in p.definition_at(uses, symbols, at(("a.py", 11), ("b.py", 3), ("a.py", 12), ("a.py", 20), ("a.py", 7), ("b.py", 5))).collect()}
    assert got == {("a.py", 11, "n.h", "b.py", 1), ("b.py", 3, "m.f", "a.py", 1), ("b.py", 3, "m.C.g", "a.py", 10), ("a.py", 12, "m.C.g", "a.py", 10), ("a.py", 20, "m.C", "a.py", 8)}
    got = {(r.key, r.ref_path, r.ref_line) for r in p.references_at(uses, symbols, at(("a.py", 2), ("b.py", 8))).collect()}
    assert got == {("m.f", "b.py", 3), ("m.f", "b.py", 4), ("n.h", "a.py", 11)}
