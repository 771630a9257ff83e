"""Value domains, table schemas, and types that follow from a field's name."""

from __future__ import annotations

import re
from enum import StrEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ScanStatus(StrEnum):
    IDLE = "idle"
    RUNNING = "running"
    COMPLETED = "completed"
    FAILED = "failed"


class FileStatus(StrEnum):
    PENDING = "pending"
    RUNNING = "running"
    COMPLETED = "completed"
    FAILED = "failed"
    SKIPPED = "skipped"


class AnalysisType(StrEnum):
    LINE_CHUNK = "line_chunk_vector"
    SYMBOL_SUMMARY = "symbol_summary_vector"


#: File extensions and the language of each.
LANGUAGES = {".py": "python", ".java": "java", ".go": "go", ".cpp": "cpp", ".c": "c", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript"}
#: Directories that a scan does not enter, beside those that start with a dot.
EXCLUDED_DIRS = ("__pycache__", ".git", ".idea", ".vscode", "venv", "node_modules", "dist", "build", "target", ".pytest_cache", ".mypy_cache", ".coverage", "__tests__", "tests")

#: The columns of each table. Tokens of accounts are not stored.
TABLES = {
    "git_auth": "id STRING, user_id STRING, provider STRING, is_active BOOLEAN, created_at TIMESTAMP, updated_at TIMESTAMP",
    "repositories": "id STRING, user_id STRING, git_provider STRING, repository_url STRING, organization STRING, repository_name STRING, branch STRING, description STRING, local_path STRING, is_cloned BOOLEAN, last_sync_time TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP",
    "analysis_tasks": "repo_id STRING, scan_status STRING, last_error STRING, last_scan_started_at TIMESTAMP, last_scan_finished_at TIMESTAMP, scan_heartbeat_at TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP",
    "file_state": "repo_id STRING, file_path STRING, status STRING, attempts INT, last_error STRING, last_started_at TIMESTAMP, last_finished_at TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP",
    "line_chunks": "id STRING, repo_id STRING, file_path STRING, analysis_type STRING, start_line INT, end_line INT, chunk_index INT, content STRING, vec ARRAY<FLOAT>",
    "symbol_summaries": "id STRING, repo_id STRING, file_path STRING, analysis_type STRING, symbol_kind STRING, symbol_name STRING, start_line INT, end_line INT, summary STRING, vec ARRAY<FLOAT>",
    "graph_nodes": "repo_id STRING, label STRING, key STRING, name STRING, full_name STRING, file_path STRING, node_type STRING, signature STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "graph_edges": "repo_id STRING, type STRING, src_label STRING, src_key STRING, dst_label STRING, dst_key STRING, updated_at TIMESTAMP",
}

#: Name patterns and their types, the first match counts.
SUFFIX_TYPES = (
    (r".*_int", "int"), (r".*_ulong", "decimal(20,0)"), (r".*_long", "bigint"), (r".*_short", "smallint"), (r".*_flt", "float"),
    (r".*_tks", "string"), (r".*_ltks", "string"), (r".*_(kwd|id|ids|uid|uids)|uid", "string"), (r".*(_dt|_time|_at)", "timestamp"),
    (r".*_nst", "string"), (r".*_obj", "string"), (r".*_(with_weight|list)", "string"), (r".*_fea", "float"), (r".*_feas", "map<string,float>"),
    (r".*_(512|768|1024|1536)_vec", "array<float>"), (r".*_bin", "binary"),
)
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy-MM-dd_HH:mm:ss")


def type_of(field: str) -> str | None:
    """The type that a field's name stands for, or None."""
    return next((kind for pattern, kind in SUFFIX_TYPES if re.fullmatch(pattern, field)), None)


def typed(df: DataFrame) -> DataFrame:
    """Cast the columns whose names stand for a type; what does not parse becomes null."""

    def cast(name: str, have: str) -> Column:
        kind, c = type_of(name), F.col(f"`{name}`")
        if kind is None or kind == have or have.startswith(("array", "map", "struct")):
            return c
        if kind == "timestamp" and have == "string":
            return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS]).alias(name)
        if kind.startswith(("array", "map")):
            return F.from_json(c, kind).alias(name)
        return c.try_cast(kind).alias(name)

    return df.select(*[cast(n, k) for n, k in df.dtypes])
