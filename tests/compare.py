"""Run a query in Spark and its SQL in DuckDB, and compare the rows."""

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return str(x) if x.__class__.__name__ in ("date", "datetime", "Decimal", "Timestamp") else x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql):
    """None, or what differs."""
    names, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    rel = con.sql(sql)
    names2, want = rows_of(rel.columns, rel.fetchall())
    if names != names2:
        return f"columns {names} and {names2}"
    if got != want:
        return f"{sum(got.values())} and {sum(want.values())} rows; only Spark {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}"
    return None
