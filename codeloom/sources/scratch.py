"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Folders of scratch tables that nothing has deleted yet, with the session that wrote them.
_left: dict[str, SparkSession] = {}


def scratch_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder if all tasks run on this machine, and else an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        folder = tempfile.mkdtemp(prefix="codeloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[app] = "file://" + folder
    return _own[app]


def scratch_folder(spark: SparkSession) -> str:
    """A new name under the shared scratch folder; what is there goes with ``discard``, or when the driver's program ends."""
    folder = f"{scratch_root(spark)}/codeloom-{uuid.uuid4().hex}"
    _left[folder] = spark
    return folder


def _delete(folder: str, spark: SparkSession) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _left.pop(folder, None)


@atexit.register
def _delete_left() -> None:
    """Results that were read from these tables have been taken by then; of a session that was stopped only local folders can be deleted."""
    for folder, spark in list(_left.items()):
        if folder.startswith("file:"):
            shutil.rmtree("/" + folder.removeprefix("file:").lstrip("/"), ignore_errors=True)
        elif spark.sparkContext._jsc:
            _delete(folder, spark)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back.

    That cuts the lineage as checkpoint() does, but computes the rows once. The files may go
    when the results that were made from them have been written: see ``discard``.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{label}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete scratch tables that nothing reads any more; tables of another kind are left alone."""
    for df in tables:
        path = getattr(df, "scratch_path", None)
        if path:
            _delete(path.rsplit("/", 1)[0], df.sparkSession)
