"""The queue as a stream against the operators on tables: a worker that dies, a late result, a new start."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from codeloom.operators import meta as m
from codeloom.streaming import work_queue as wq

START = dt.datetime(2024, 1, 1)
STATES = "repo_id string, file_path string, status string, attempts int, last_error string, last_started_at timestamp, last_finished_at timestamp, created_at timestamp, updated_at timestamp"


def t(minutes):
    return START + dt.timedelta(minutes=minutes)


def event(kind, at, repo="r", path=None, worker=None, n=None, attempt=None, ok=None, error=None):
    return (repo, kind, path, worker, n, attempt, ok, error, t(at))


#: Batches of events: w1 takes a and b and dies; its lease is over at 31, w2 takes c and then a again, and w1's result for a comes too late.
BATCHES = [
    [event("changed", 0, path=p) for p in "abc"] + [event("changed", 0, "s", "z")],
    [event("ask", 1, worker="w1", n=2), event("ask", 1, "s", worker="w1", n=5)],
    [event("result", 2, "s", "z", attempt=1, ok=False, error="boom")],
    [event("ask", 40, worker="w2", n=2), event("ask", 40, "s", worker="w2", n=1)],
    [event("result", 41, path="a", attempt=1, ok=True), event("result", 42, path="a", attempt=2, ok=True), event("result", 42, path="b", attempt=2, ok=False, error="no")],
    [event("changed", 43, path="a"), event("ask", 44, worker="w3", n=9), event("result", 45, path="c", attempt=1, ok=True)],
]


def by_tables(spark):
    """The same by claim and finish on one table of states, event after event."""
    states = spark.createDataFrame([], STATES)
    for e in sorted((e for b in BATCHES for e in b), key=lambda e: (e[8], e[1])):
        repo, kind, path, worker, n, attempt, ok, error, at = e
        now = F.lit(at)
        own, rest = states.where(F.col("repo_id") == repo), states.where(F.col("repo_id") != repo)
        if kind == "changed":
            new = spark.createDataFrame([(repo, path, "pending", 0, None, None, None, at, at)], STATES)
            own = own.where(F.col("file_path") != path).unionByName(new)
        elif kind == "ask":
            own = m.claim(own, n, now)
        elif own.where((F.col("file_path") == path) & (F.col("status") == "running") & (F.col("attempts") == attempt)).count():
            own = m.finish(own, spark.createDataFrame([(repo, path, ok, error)], "repo_id string, file_path string, ok boolean, error string"), now)
        states = spark.createDataFrame(own.unionByName(rest).collect(), STATES)
    return {(r.repo_id, r.file_path): (r.status, r.attempts) for r in states.collect()}


@pytest.mark.parametrize("shards", [1, 3])
def test_stream_equals_tables(spark, tmp_path, shards):
    wq.use_state_store(spark)
    log = None
    for batch in BATCHES:  # each batch is a new start from the checkpoint
        spark.createDataFrame(batch, wq.EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = wq.queue_log(spark.readStream.schema(wq.EVENT).parquet(f"{tmp_path}/in"), shards=shards)
        out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/log").awaitTermination()
        log = spark.read.schema(wq.LOG).parquet(f"{tmp_path}/log")
    rows = log.collect()
    if shards == 1:
        got = {(r.repo_id, r.file_path): (r.status, r.attempts) for r in wq.states_of(log).collect()}
        assert got == by_tables(spark)
        taken = [(r.file_path, r.worker) for r in sorted(rows, key=lambda r: r.number) if r.event == "assigned" and r.repo_id == "r"]
        assert taken == [("a", "w1"), ("b", "w1"), ("c", "w2"), ("a", "w2"), ("b", "w3"), ("a", "w3")]
        assert {(r.file_path, r.attempts) for r in rows if r.event == "late"} == {("a", 2), ("b", 1)}
    assert len({(r.repo_id, r.shard, r.number) for r in rows}) == len(rows)
    assert {r.file_path for r in rows if r.event == "expired"} <= {"a", "b"}


def test_results_of_workers(spark):
    def analyse(repo, path):
        if path == "bad":
            raise ValueError("cannot be read")

    log = spark.createDataFrame([("r", 0, k, "assigned", p, "running", 1, "w", None, t(1)) for k, p in enumerate(["good", "bad"])] + [("r", 0, 2, "late", "x", "completed", 1, "w", None, t(1))], wq.LOG)
    got = {r.file_path: (r.ok, r.error) for r in wq.worked(log, analyse).collect()}
    assert got == {"good": (True, None), "bad": (False, "ValueError: cannot be read")}
