"""Messages that come in bursts: the last one of each burst counts, merged over those who sent them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_of_bursts(messages: DataFrame, gap: str, watermark: str, by: list[str], value: str, ts: str = "ts", order: str | None = None) -> DataFrame:
    """(by, started, ended, n, value): of every burst its last message.

    A burst ends when nothing came for longer than ``gap``. Of messages of one time that with the greatest
    ``order``, a column, counts, and without one that with the greatest value. On a stream a burst
    comes out when the watermark has passed its end, and later messages are left out; the state of
    an open burst is one message, however many came.
    """
    rows = messages.withWatermark(ts, watermark) if messages.isStreaming else messages
    last = F.max_by(F.col(value), F.struct(F.col(ts), F.col(order or value)))
    found = rows.where(F.col(ts).isNotNull()).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("n"), last.alias(value))
    return found.select(*by, "started", "ended", "n", value)


def merged(bursts: DataFrame, file: list[str], client: str, items: str) -> DataFrame:
    """(file, items, n_clients): what all clients say last about a file, each item once, in order. A client whose last burst has no items takes back what it said."""
    latest = bursts.groupBy(*file, client).agg(F.max_by(items, "ended").alias("__items"))
    counts = latest.groupBy(*file).agg(F.count(F.lit(1)).alias("n_clients"))
    each = latest.select(*file, F.explode("__items").alias("item")).distinct().groupBy(*file).agg(F.array_sort(F.collect_list("item")).alias(items))
    kind = dict(bursts.dtypes)[items]
    return counts.join(each, file, "left").select(*file, F.coalesce(items, F.array().cast(kind)).alias(items), "n_clients")
