"""Bursts of messages, as a table and as a stream."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from codeloom.streaming import bursts as b

KIND = "ts timestamp, file string, client string, items array<string>"
START = dt.datetime(2024, 1, 1)


def rows_of(seed=0, n=120):
    rng = random.Random(seed)
    out, at = [], START
    for _ in range(n):
        at += dt.timedelta(seconds=rng.choice([1, 2, 5, 30]))
        out.append((at, rng.choice("ab"), rng.choice("xy"), sorted(rng.sample(["e1", "e2", "e3"], rng.randrange(4)))))
    return out


def brute(rows, gap):
    found = []
    for key in sorted({(r[1], r[2]) for r in rows}):
        own = sorted(r for r in rows if (r[1], r[2]) == key)
        burst = [own[0]]
        for r in own[1:]:
            if (r[0] - burst[-1][0]).total_seconds() > gap:
                found.append((*key, burst[0][0], burst[-1][0], len(burst), burst[-1][3]))
                burst = []
            burst.append(r)
        found.append((*key, burst[0][0], burst[-1][0], len(burst), burst[-1][3]))
    return found


def test_last_of_each_burst(spark):
    rows = rows_of()
    df = spark.createDataFrame([*rows, (None, "a", "x", ["late"])], KIND)
    got = b.last_of_bursts(df, "10 seconds", "1 minute", ["file", "client"], "items")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows, 10), key=str)
    same = spark.createDataFrame([(START, "a", "x", ["1"]), (START, "a", "x", ["2"])], KIND)
    assert b.last_of_bursts(same, "10 seconds", "1 minute", ["file"], "items").first().items == ["2"]


def test_merged_over_clients(spark):
    t = lambda s: START + dt.timedelta(seconds=s)
    rows = [("a", "x", t(0), t(1), 2, ["old"]), ("a", "x", t(50), t(51), 1, ["e1", "e2"]), ("a", "y", t(20), t(20), 1, ["e2", "e0"]), ("b", "x", t(0), t(0), 1, ["e"]), ("b", "x", t(9), t(9), 1, [])]
    df = spark.createDataFrame(rows, "file string, client string, started timestamp, ended timestamp, n long, items array<string>")
    assert {r.file: (r.items, r.n_clients) for r in b.merged(df, ["file"], "client", "items").collect()} == {"a": (["e0", "e1", "e2"], 2), "b": ([], 1)}


@pytest.mark.parametrize("parts", [1, 4])
def test_stream_equals_table(spark, tmp_path, parts):
    """Bursts come out once their end is past the watermark; one that is open over several batches is one."""
    rows = rows_of(3, 80)
    last = rows[-1][0] + dt.timedelta(hours=1)
    step = -(-len(rows) // parts)
    batches = [rows[i : i + step] for i in range(0, len(rows), step)] + [[(last, "z", "z", [])], [(last, "z", "z", [])]]
    for batch in batches:
        spark.createDataFrame(batch, KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(KIND).parquet(f"{tmp_path}/in")
        out = b.last_of_bursts(source, "10 seconds", "20 seconds", ["file", "client"], "items")
        out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").where(F.col("file") != "z").collect()]
    assert sorted(got, key=str) == sorted(brute(rows, 10), key=str)
