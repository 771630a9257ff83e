"""Repositories and what belongs to them: lookups, changes by their owner, accounts, cancelled scans."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import absolute_path, git_parts
from codeloom.operators.meta import under_any
from codeloom.schema import ScanStatus


class ScanCancelled(RuntimeError):
    """The scan's status is no longer that of a running one."""


def resolve(repos: DataFrame, repo_id: str | None = None, path: str | None = None, base: str = "/") -> DataFrame:
    """The repository with an id; without one that whose local path, made absolute and plain, is the path so made."""
    if repo_id:
        return repos.where(F.col("id") == repo_id)
    if not path:
        return repos.where("false")
    return repos.where("local_path is not null and local_path <> ''").where(absolute_path(F.col("local_path"), base) == absolute_path(F.lit(path), base))


def register(
    repos: DataFrame, repo_id: str, user_id: str, now: Column, name: str | None = None, url: str | None = None, package: str | None = None, path: str | None = None,
    description: str | None = None, branch: str | None = None, storage: str = "/data/repos",
) -> DataFrame:
    """Repositories with a new one: from a remote URL, from an uploaded package, or from a path on the server, which may have a URL too.

    Exactly one of them says where it comes from. A repository that its user has already is an error:
    of a URL with the same provider, organization and name, else with the same name.
    """
    if sum(bool(x) for x in (package, path, url and not path)) != 1:
        raise ValueError("a repository comes from a URL, a package or a path")
    parts = git_parts(F.lit(url.strip() if url else ""))
    if package or path:
        if not name:
            raise ValueError("a repository that is no URL's needs a name")
        provider = F.lit("uploaded") if package else F.coalesce(parts["provider"], F.lit("local"))
        organization = F.lit("uploaded") if package else F.when(F.lit(bool(url)), parts["organization"]).otherwise("local")
        own = {"git_provider": provider, "organization": organization, "repository_name": F.lit(name), "branch": F.lit("main"), "local_path": F.lit(path or f"{storage}/uploads/{user_id}/{name}")}
    else:
        if not re.match(r"https?://|git@", url.strip()):
            raise ValueError("no URL of a repository")
        own = {"git_provider": parts["provider"], "organization": parts["organization"], "repository_name": parts["name"], "branch": F.lit(branch or "main")}
        own["local_path"] = F.concat_ws("/", F.lit(storage), parts["organization"], parts["name"])
    own |= {"id": F.lit(repo_id), "user_id": F.lit(user_id), "repository_url": F.lit((url or "").strip()), "description": F.lit(description), "is_cloned": F.lit(False), "created_at": now, "updated_at": now}
    new = repos.sparkSession.range(1).select(*[own.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in repos.dtypes])
    keys = ["repository_name", "user_id", *([] if package or path else ["git_provider", "organization"])]
    if not new.join(repos.select(*keys), keys, "left_semi").limit(1).count() == 0:
        raise ValueError("the user has this repository already")
    return repos.unionByName(new)


def exists(repos: DataFrame, repo_id: str) -> bool:
    return not resolve(repos, repo_id).isEmpty()


def work_item(states: DataFrame, record_id: str) -> DataFrame:
    """The file state that a worker takes up."""
    return states.where(F.col("id") == record_id)


def repos_with_work(states: DataFrame) -> DataFrame:
    """Distinct repo_id with pending or failed files."""
    return states.where(F.col("status").isin("pending", "failed")).select("repo_id").distinct()


def gone_from_scan(states: DataFrame, scan: DataFrame, key: list[str]) -> DataFrame:
    """States of files that a scan does not have."""
    return states.join(scan.select(*key).distinct(), key, "left_anti")


def outside(states: DataFrame, excluded: DataFrame) -> DataFrame:
    """States of files under none of the excluded folders (column folder)."""
    return under_any(states, excluded, how="left_anti")


def owned(repos: DataFrame, repo_id: str, user_id: str) -> DataFrame:
    """The one row of a repository; an error where there is none or it is another user's."""
    own = resolve(repos, repo_id)
    row = own.select("user_id").first()
    if row is None:
        raise LookupError(f"no repository {repo_id}")
    if row.user_id != user_id:
        raise PermissionError(f"repository {repo_id} is another user's")
    return own


def update_repository(repos: DataFrame, repo_id: str, user_id: str, now: Column, description: str | None = None, url: str | None = None, branch: str | None = None) -> DataFrame:
    """Repositories with one changed by its owner; provider, organization and name follow the URL, and a provider that is not known is ``local``."""
    owned(repos, repo_id, user_id)
    new: dict[str, Column] = {"updated_at": now}
    if description is not None:
        new["description"] = F.lit(description)
    if url is not None:
        parts = git_parts(F.lit(url.strip()))
        new |= {"repository_url": F.lit(url.strip()), "git_provider": F.coalesce(parts["provider"], F.lit("local")), "organization": parts["organization"], "repository_name": parts["name"]}
    if branch is not None:
        new["branch"] = F.lit(branch)
    here = F.col("id") == repo_id
    return repos.withColumns({c: F.when(here, v).otherwise(F.col(c)) for c, v in new.items()})


def delete_repository(repos: DataFrame, belonging: dict[str, DataFrame], repo_id: str, user_id: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(other repositories, what stays of each table that has a repo_id): all analysis of a repository goes with it, if its owner asks."""
    owned(repos, repo_id, user_id)
    return repos.where(F.col("id") != repo_id), {name: df.where(~F.col("repo_id").eqNullSafe(F.lit(repo_id))) for name, df in belonging.items()}


def save_auth(current: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Accounts after those of ``new`` (id, user_id, provider) are saved: an active one keeps its id and is touched, others come in. Tokens are not stored.

    Of several new ones of a user and provider that with the least id comes in; without a user or a
    provider none does.
    """
    key = ["user_id", "provider"]
    new = new.dropna(subset=key).groupBy(*key).agg(F.min("id").alias("id"))
    touched = current.join(new.select(*key, F.lit(True).alias("__new")), key, "left").withColumn("updated_at", F.when(F.col("is_active") & F.col("__new"), now).otherwise(F.col("updated_at")))
    fresh = new.join(current.where("is_active").select(*key), key, "left_anti").select("id", *key, F.lit(True).alias("is_active"), now.alias("created_at"), now.alias("updated_at"))
    return touched.select(*current.columns).unionByName(fresh.select(*current.columns))


def auths_of(current: DataFrame, user_id: str, provider: str | None = None) -> DataFrame:
    own = current.where((F.col("user_id") == user_id) & F.col("is_active"))
    return own if provider is None else own.where(F.col("provider") == provider)


def delete_auth(current: DataFrame, user_id: str, provider: str) -> tuple[DataFrame, bool]:
    """(accounts that stay, whether one went)."""
    hit = (F.col("user_id") == user_id) & (F.col("provider") == provider)
    return current.where(~F.coalesce(hit, F.lit(False))), not current.where(hit).isEmpty()


def heartbeat(tasks: DataFrame, repo_id: str, now: Column) -> DataFrame:
    """Tasks with the sign of life of one renewed."""
    return tasks.withColumn("scan_heartbeat_at", F.when(F.col("repo_id") == repo_id, now).otherwise(F.col("scan_heartbeat_at")))


def check_running(tasks: DataFrame, repo_id: str) -> None:
    """Raise ScanCancelled unless the task's status is still that of a running scan; a scan asks between its batches."""
    row = tasks.where(F.col("repo_id") == repo_id).select("scan_status").first()
    if row is None or row.scan_status != ScanStatus.RUNNING.value:
        raise ScanCancelled(repo_id)
