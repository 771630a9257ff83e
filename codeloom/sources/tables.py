"""Readers for the parquet tables that the queries run on."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder.

    The path goes to Spark as it is, so any file system that Spark knows will do.
    Timestamps without a zone become ``TIMESTAMP``: watermarks need that type.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = {c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.withColumns(naive) if naive else df
