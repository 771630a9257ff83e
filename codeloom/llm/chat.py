"""Chat formatting: logged snapshots of the same conversation collapse into the longest one.

A hash of the turns so far is carried along every conversation. A conversation whose last hash is
a hash inside a longer one is a snapshot of it and goes; of equal ones the smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.sources.tables import read_table

ORACLE_OP10 = """
with rows as (
  select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text,
    case when conv_id is null then coalesce(turn::varchar, '') || chr(31) || coalesce(role, '') || chr(31) || coalesce(text, '') end as own
  from conversations),
turns as (
  select *, row_number() over (partition by conv_id, own order by turn nulls first, role, text) as n from rows),
prefixes as (
  select conv_id, own, n, string_agg(role || chr(31) || text, chr(30)) over (
    partition by conv_id, own order by n rows unbounded preceding) as prefix from turns),
whole as (
  select conv_id, own, max(n) as n_turns, max_by(prefix, n) as prefix from prefixes group by conv_id, own),
firsts as (
  select first(conv_id order by conv_id nulls last, own) as conv_id, first(own order by conv_id nulls last, own) as own,
    n_turns, prefix, count(*) as n_equal from whole group by n_turns, prefix),
kept as (
  select * from firsts f where not exists (
    select 1 from prefixes p join whole w on p.conv_id = w.conv_id
    where p.n < w.n_turns and p.n = f.n_turns and p.prefix = f.prefix))
select k.conv_id, k.n_turns, k.n_equal,
  string_agg('<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10), '' order by t.n) as rendered
from kept k join turns t on t.conv_id is not distinct from k.conv_id and t.own is not distinct from k.own
group by k.conv_id, k.own, k.n_turns, k.n_equal
"""


def collapse(conversations: DataFrame) -> DataFrame:
    """One row for each maximal conversation: conv_id, n_turns, n_equal (logs of just these turns), rendered.

    Turns are taken in the order of turn, then role, then text; rows repeated in every column
    count once; null roles and texts count as empty. A row without a conv_id is a conversation of its
    own, so that however many there are, they do not meet in one task. An empty table gives no rows.
    Other columns do not matter.
    """
    order = Window.partitionBy("conv_id", "own").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    # Rows that repeat become one where they are read, so that many of them are no single task's work.
    turns = (
        conversations.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
        .distinct()
        .withColumn("own", F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")))
        .withColumn("n", F.row_number().over(order))
    )
    # Each turn's hash includes its place, so that their exclusive or stands for the sequence; two of 64 bits make one of 128.
    so_far = Window.partitionBy("conv_id", "own").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hashed = turns.select(
        "conv_id", "own", "n", *[F.bit_xor(F.xxhash64(F.lit(salt), "n", "role", "text")).over(so_far).alias(h) for h, salt in (("h1", 1), ("h2", 2))]
    ).withColumn("n_turns", F.max("n").over(Window.partitionBy("conv_id", "own")))
    name = F.min(F.struct(F.col("conv_id").isNull(), "conv_id", "own")).alias("name")
    whole = hashed.where("n = n_turns").groupBy("h1", "h2", "n").agg(name, F.count(F.lit(1)).alias("n_equal"))
    inside = hashed.where("n < n_turns").select("h1", "h2", "n").distinct()
    kept = whole.join(inside, ["h1", "h2", "n"], "left_anti").select("name.conv_id", "name.own", F.col("n").cast("long").alias("n_turns"), "n_equal")
    said = F.concat(F.lit("<|"), F.col("t.role"), F.lit("|>\n"), F.col("t.text"), F.lit("<|end|>\n"))
    k, t = kept.alias("k"), turns.alias("t")
    return (
        t.join(k, F.col("t.conv_id").eqNullSafe(F.col("k.conv_id")) & F.col("t.own").eqNullSafe(F.col("k.own")))
        .select("k.conv_id", "k.own", "k.n_turns", "k.n_equal", F.struct("t.n", said.alias("said")).alias("turn"))
        .groupBy("conv_id", "own", "n_turns", "n_equal")
        .agg(F.array_sort(F.collect_list("turn")).alias("turns"))
        .select("conv_id", "n_turns", "n_equal", F.array_join(F.col("turns.said"), "").alias("rendered"))
    )


def op10_snapshot_collapse(spark, sf_dir: str) -> DataFrame:
    """All conversations, without the snapshots of longer ones, rendered."""
    return collapse(read_table(spark, sf_dir, "conversations"))
