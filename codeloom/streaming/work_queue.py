"""A queue of files to analyse, as the state of a stream: claims, leases, retries.

Events of a repository change the state of its files, and every change comes out as a row of a log:
what a worker may take up, what it has done, whose lease is over. Leases end by the watermark, so a
stream that starts again from its checkpoint goes on as it would have. A long queue can be spread over
``shards``, which are asked one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: ``kind`` is changed (file_path), ask (worker, n) or result (file_path, attempt, ok, error).
EVENT = "repo_id string, kind string, file_path string, worker string, n int, attempt int, ok boolean, error string, at timestamp"
LOG = "repo_id string, shard int, number long, event string, file_path string, status string, attempts int, worker string, error string, updated_at timestamp"
STATE = ("status", "attempts", "updated_at", "lease_until", "worker", "error")


class Queue(StatefulProcessor):
    """The files of one repository, or of a shard of it, by path."""

    def __init__(self, lease_ms: int, attempts: int):
        self.lease_ms, self.most = lease_ms, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getMapState("files", "file_path string", "status string, attempts int, updated_at long, lease_until long, worker string, error string")
        self.count = handle.getValueState("count", "n long")

    def _log(self, key, rows: list[tuple[str, str, dict]]) -> Iterator[pd.DataFrame]:
        if not rows:
            return
        n = self.count.get()[0] if self.count.exists() else 0
        self.count.update((n + len(rows),))
        out = [(key[0], key[1], n + i, event, path, f["status"], f["attempts"], f["worker"], f["error"], pd.Timestamp(f["updated_at"], unit="ms")) for i, (event, path, f) in enumerate(rows)]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in LOG.split(", ")])

    def _all(self) -> dict[str, dict]:
        return {k[0]: dict(zip(STATE, v, strict=True)) for k, v in self.files.iterator()}

    def _save(self, files: dict[str, dict], paths: set[str]) -> None:
        for path in paths:
            self.files.updateValue((path,), tuple(files[path][c] for c in STATE))

    def _waits(self, f: dict, now: int) -> bool:
        return f["status"] == "pending" or f["status"] == "failed" and f["attempts"] < self.most or f["status"] == "running" and f["lease_until"] < now

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at", "kind", "file_path", "worker"], kind="stable")
        files, touched, log = self._all(), set(), []
        for e in events.to_dict("records"):
            now, path = e["at"].value // 1_000_000, e["file_path"]
            if e["kind"] == "changed":
                files[path] = {"status": "pending", "attempts": 0, "updated_at": now, "lease_until": 0, "worker": None, "error": None}
                touched.add(path)
                log.append(("changed", path, dict(files[path])))
            elif e["kind"] == "ask":
                waiting = sorted((f["updated_at"], p) for p, f in files.items() if self._waits(f, now))
                for _, p in waiting[: int(e["n"])]:
                    files[p] |= {"status": "running", "attempts": files[p]["attempts"] + 1, "updated_at": now, "lease_until": now + self.lease_ms, "worker": e["worker"]}
                    touched.add(p)
                    log.append(("assigned", p, dict(files[p])))
                    self.handle.registerTimer(now + self.lease_ms + 1)
            elif path in files:
                f = files[path]
                if f["status"] != "running" or f["attempts"] != int(e["attempt"]):
                    log.append(("late", path, dict(f)))  # of an attempt that is no longer the file's
                    continue
                f |= {"status": "completed" if e["ok"] else "failed", "error": e["error"] if isinstance(e["error"], str) else None, "updated_at": now, "lease_until": 0}
                touched.add(path)
                log.append((f["status"], path, dict(f)))
        self._save(files, touched)
        yield from self._log(key, log)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """What runs past its lease waits again, at the place it had."""
        now, files = expiredTimerInfo.getExpiryTimeInMs(), self._all()
        over = sorted(p for p, f in files.items() if f["status"] == "running" and f["lease_until"] < now)
        for p in over:
            files[p] |= {"status": "pending", "lease_until": 0}
        self._save(files, set(over))
        yield from self._log(key, [("expired", p, files[p]) for p in over])

    def close(self) -> None:
        pass


def queue_log(events: DataFrame, lease_s: int = 1800, attempts: int = 5, shards: int = 1, delay: str = "1 minute") -> DataFrame:
    """The log of a stream of events. An event that is later than the watermark (``delay`` behind the latest) still counts, at its own time; only leases end by the watermark.

    Asks go to every shard of the repository. The session has to keep state in RocksDB
    (``use_state_store``).
    """
    own = F.when(F.col("kind") == "ask", F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(F.pmod(F.xxhash64("file_path"), F.lit(shards)).cast("int")))
    rows = events.withWatermark("at", delay).where("repo_id is not null and at is not null").withColumn("shard", F.explode(own))
    return rows.groupBy("repo_id", "shard").transformWithStateInPandas(Queue(lease_s * 1000, attempts), LOG, "Append", "EventTime")


def use_state_store(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def states_of(log: DataFrame) -> DataFrame:
    """(repo_id, file_path, status, attempts, worker, error, updated_at): each file's state after a log, in any order."""
    rest = ["status", "attempts", "worker", "error", "updated_at"]
    return log.groupBy("repo_id", "file_path").agg(F.max_by(F.struct(*rest), "number").alias("s")).select("repo_id", "file_path", "s.*")


def worked(assigned: DataFrame, analyse: Callable[[str, str], None], workers: int = 4) -> DataFrame:
    """Result events of the assigned rows of a log, each file analysed in one of as many tasks; an exception is a failed file and no failed job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            errors = []
            for repo, path in zip(pdf["repo_id"], pdf["file_path"], strict=True):
                try:
                    analyse(repo, path)
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"repo_id": pdf["repo_id"], "kind": "result", "file_path": pdf["file_path"], "worker": pdf["worker"], "n": None, "attempt": pdf["attempts"], "ok": [e is None for e in errors], "error": errors, "at": pdf["updated_at"]})

    rows = assigned.where("event = 'assigned'").select("repo_id", "file_path", "worker", "attempts", "updated_at")
    return rows.repartition(workers, "repo_id", "file_path").mapInPandas(run, EVENT)
