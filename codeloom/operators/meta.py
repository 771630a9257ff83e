"""Repositories, scan tasks and file states: listing, incremental change, claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.schema import FileStatus


def list_repositories(repos: DataFrame, keyword: str | None, page: int, size: int, **equal) -> tuple[DataFrame, DataFrame]:
    """(all that match, one page of them), newest first; a keyword may occur in the name, description or organization."""
    own = repos
    for name, value in equal.items():
        own = own.where(F.col(name) == value)
    if keyword:
        k = keyword.lower()
        fields = ("repository_name", "description", "organization")
        hit = F.lit(False)
        for f in fields:
            hit = hit | F.coalesce(F.lower(f).contains(k), F.lit(False))
        own = own.where(hit)
    return own, own.orderBy(F.desc("created_at"), "id").offset((page - 1) * size).limit(size)


def register_repositories(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Those of ``new`` that are not there yet, by key (nulls are equal), come in."""
    on = None
    a, b = new.alias("a"), current.alias("b")
    for k in keys:
        same = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        on = same if on is None else on & same
    return current.unionByName(a.join(b, on, "left_anti"), allowMissingColumns=True)


def status_summary(states: DataFrame, by: list[str] | None = None, status: str = "status") -> DataFrame:
    """Five counters and the total; a status that does not occur counts 0."""
    counts = [F.count_if(F.col(status) == s.value).alias(s.value) for s in FileStatus]
    return states.groupBy(*(by or [])).agg(*counts, F.count(F.lit(1)).alias("total"))


def needs_refresh(mtime: Column, finished: Column) -> Column:
    return finished.isNull() | (mtime > finished)


def diff(states: DataFrame, scan: DataFrame, now: Column) -> DataFrame:
    """File states after a scan (repo_id, file_path, mtime).

    New files are pending; changed ones, or ones never finished, are pending again; missing ones go.
    """
    s, d = states.alias("s"), scan.alias("d")
    both = s.join(d, (F.col("s.repo_id") == F.col("d.repo_id")) & (F.col("s.file_path") == F.col("d.file_path")), "right")
    known = F.col("s.file_path").isNotNull()
    again = known & needs_refresh(F.col("d.mtime"), F.col("s.last_finished_at"))
    reset = ~known | again
    columns = {
        "repo_id": F.col("d.repo_id"), "file_path": F.col("d.file_path"),
        "status": F.when(reset, F.lit(FileStatus.PENDING.value)).otherwise(F.col("s.status")),
        "attempts": F.when(reset, F.lit(0)).otherwise(F.col("s.attempts")),
        "last_error": F.when(reset, F.lit(None)).otherwise(F.col("s.last_error")),
        "created_at": F.coalesce("s.created_at", now), "updated_at": F.when(reset, now).otherwise(F.col("s.updated_at")),
    }
    return both.select(*[columns.get(c, F.col(f"s.{c}")).alias(c) for c in states.columns])


def prefixes(path: Column) -> Column:
    """A path itself and all folders above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def under_any(files: DataFrame, folders: DataFrame, key: str = "file_path", how: str = "left_semi") -> DataFrame:
    """Files that are or lie under any of the paths in column folder, or with how='left_anti' none of them: by equality with each one's own path and the folders above it, not by ranges."""
    above = files.select(key, F.explode(prefixes(F.col(key))).alias("folder"))
    hits = above.join(folders, "folder", "left_semi").select(key).distinct()
    return files.join(hits, key, how)


def heads(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each queue. Rows are combined before they move, so a long queue is no single task's work."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("head")).select(*by, "head.*")


def claim(states: DataFrame, n: int, now: Column, lease: str = "INTERVAL 30 MINUTES", attempts: int = 5) -> DataFrame:
    """States with the ``n`` oldest waiting files marked running.

    Waiting are pending files, failed ones with attempts left, and running ones whose lease is over.
    """
    waiting = (F.col("status") == "pending") | ((F.col("status") == "failed") & (F.col("attempts") < attempts)) | ((F.col("status") == "running") & (F.col("updated_at") < now - F.expr(lease)))
    heads = states.where(waiting).orderBy("updated_at", "repo_id", "file_path").limit(n).select("repo_id", "file_path", F.lit(True).alias("__own"))
    out = states.join(heads, ["repo_id", "file_path"], "left")
    own = F.coalesce("__own", F.lit(False))
    new = {"status": F.lit("running"), "attempts": F.coalesce("attempts", F.lit(0)) + 1, "last_started_at": now, "updated_at": now}
    return out.withColumns({c: F.when(own, v).otherwise(F.col(c)) for c, v in new.items()}).select(*states.columns)


def finish(states: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """States with results (repo_id, file_path, ok, error) entered; only completed files get last_finished_at."""
    out = states.join(results, ["repo_id", "file_path"], "left")
    done = F.col("ok").isNotNull()
    new = {
        "status": F.when(F.col("ok"), "completed").otherwise("failed"), "last_error": F.col("error"),
        "last_finished_at": F.when(F.col("ok"), now).otherwise(F.col("last_finished_at")), "updated_at": now,
    }
    return out.withColumns({c: F.when(done, v).otherwise(F.col(c)) for c, v in new.items()}).select(*states.columns)


def may_start(tasks: DataFrame, repo_id: str, now: Column) -> DataFrame:
    """Tasks with one marked running, unless it is running already; a task that is not there is added."""
    free = (F.col("repo_id") == repo_id) & F.col("scan_status").isin("idle", "completed", "failed")
    out = tasks.withColumns({c: F.when(free, v).otherwise(F.col(c)) for c, v in {"scan_status": F.lit("running"), "last_scan_started_at": now, "scan_heartbeat_at": now, "updated_at": now}.items()})
    new = tasks.sparkSession.range(1).select(F.lit(repo_id).alias("repo_id"), F.lit("running").alias("scan_status"), *[now.alias(c) for c in ("last_scan_started_at", "scan_heartbeat_at", "created_at", "updated_at")])
    return out.unionByName(new.join(tasks, "repo_id", "left_anti"), allowMissingColumns=True)
