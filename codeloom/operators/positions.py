"""What is at a line of a file: enclosing spans, definitions and references, by joins on line buckets.

A span of lines is cut into the few aligned blocks of 1, 2, 4, 8 ... lines that make it up, and a
line belongs to one block of every size. So the spans around a line are found by equality of blocks;
a long span has no more than two blocks of a size, and no pair is made that does not hold. Where only
the innermost span is asked for, a sweep through sorted lines finds it without those pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Lines are below 2 to this power.
SIZES = 31


def blocks_of(start: Column, end: Column) -> Column:
    """The blocks (size, block) that make up the lines from start to end, both included: from the ends inwards, at each size what is not aligned to the next."""
    zero = F.struct(start.cast("long").alias("low"), (end.cast("long") + 1).alias("high"), F.array().cast("array<struct<size:int,block:bigint>>").alias("found"))
    block = lambda size, b: F.struct(size.alias("size"), b.cast("long").alias("block"))

    def step(s: Column, size: Column) -> Column:
        odd_low = (s["low"] < s["high"]) & (s["low"] % 2 == 1)
        low = F.when(odd_low, s["low"] + 1).otherwise(s["low"])
        odd_high = (low < s["high"]) & (s["high"] % 2 == 1)
        high = F.when(odd_high, s["high"] - 1).otherwise(s["high"])
        none = F.array().cast("array<struct<size:int,block:bigint>>")
        added = F.concat(F.when(odd_low, F.array(block(size, s["low"]))).otherwise(none), F.when(odd_high, F.array(block(size, high))).otherwise(none))
        return F.struct(F.floor(low / 2).alias("low"), F.floor(high / 2).alias("high"), F.concat(s["found"], added).alias("found"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(SIZES - 1)), zero, step, lambda s: s["found"])


def enclosing(spans: DataFrame, points: DataFrame, file: list[str]) -> DataFrame:
    """Every point with every span of its file that holds its line.

    ``spans`` has the columns ``file``, start_line and end_line, ``points`` has ``file`` and line; all
    other columns stay, of which none may be in both. Spans that end before they start, and nulls,
    meet nothing.
    """
    cut = spans.where("start_line >= 0 and start_line <= end_line").withColumn("__b", F.explode(blocks_of(F.col("start_line"), F.col("end_line"))))
    sizes = F.sequence(F.lit(0), F.lit(SIZES - 1))
    at = points.where("line >= 0").withColumn("__b", F.explode(F.transform(sizes, lambda k: F.struct(k.alias("size"), F.call_function("shiftright", F.col("line").cast("long"), k).alias("block")))))
    both = at.withColumns({"__size": F.col("__b.size"), "__block": F.col("__b.block")}).drop("__b")
    cut = cut.withColumns({"__size": F.col("__b.size"), "__block": F.col("__b.block")}).drop("__b")
    return both.join(cut, [*file, "__size", "__block"]).drop("__size", "__block")


def _swept(rows: DataFrame, own: list[str]) -> DataFrame:
    """(columns of ``__p``, columns of ``__s``): every point with the span that started last of those that have not ended, from rows sorted by file, tile and place.

    Of spans that are open in a tile those that a later one outlasts can't be an answer any more, so
    no more are held than a tile has lines.
    """
    p, s = rows.schema["__p"].dataType, rows.schema["__s"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, ends, group = None, [], [], None
        for batch in batches:
            spans = batch.column("__s")
            base = len(held) if held is not None else 0
            spans = pa.concat_arrays([held, spans]) if base else spans
            groups = list(zip(*(batch.column(c).to_pylist() for c in own), strict=True))
            point, answer = [], []
            for i, (g, line, end) in enumerate(zip(groups, batch.column("__line").to_pylist(), batch.column("__end").to_pylist(), strict=True)):
                if g != group:
                    at, ends, group = [], [], g
                if end is None:
                    while ends and ends[-1] < line:
                        ends.pop()
                        at.pop()
                    if ends:
                        point.append(i)
                        answer.append(at[-1])
                else:
                    while ends and ends[-1] <= end:
                        ends.pop()
                        at.pop()
                    ends.append(end)
                    at.append(base + i)
            points, found = batch.column("__p").take(pa.array(point, pa.int64())), spans.take(pa.array(answer, pa.int64()))
            yield pa.RecordBatch.from_arrays([*points.flatten(), *found.flatten()], names=[*p.names, *s.names])
            held, at = spans.take(pa.array(at, pa.int64())), list(range(len(at)))

    return rows.select(*own, "__line", "__end", "__p", "__s").mapInArrow(run, StructType([*p.fields, *s.fields]))


def innermost(spans: DataFrame, points: DataFrame, file: list[str], key: str = "key", tile: int = 12) -> DataFrame:
    """Every point with the innermost span around it: that which starts last, then ends first, then has the least key. Points outside all spans are left out; points that repeat are one.

    Files are cut into tiles of 2 to the power ``tile`` lines. A span goes to the tiles of its first
    and last line, and a sweep through the lines of a tile answers its points, so a span moves twice
    at most and a point once. The tiles between, for spans that are as long, are cut into aligned
    blocks; of each block only the best span counts, and of those around a tile the best joins its sweep.
    """
    known = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in file])
    last = F.lit(1 << tile) - 1
    tile_of = lambda c: F.shiftright(F.col(c).cast("long"), tile)
    rest = [c for c in spans.columns if c not in file]
    own = [*(f"__f{i}" for i in range(len(file))), "__tile"]
    named = [F.col(f).alias(own[i]) for i, f in enumerate(file)]
    spans = spans.where(known & (F.col("start_line") >= 0) & (F.col("start_line") <= F.col("end_line"))).select(
        *named, F.struct(*rest).alias("__s"), F.struct(-F.col("start_line").cast("long"), F.col("end_line"), F.col(key)).alias("__order"), tile_of("start_line").alias("__first"), tile_of("end_line").alias("__last")
    )
    points = points.distinct().where(known & (F.col("line") >= 0)).select(*named, tile_of("line").alias("__tile"), F.col("line").cast("long").alias("__line"), F.struct(*points.columns).alias("__p"))
    ends = spans.select(*own[:-1], F.explode(F.array_distinct(F.array("__first", "__last"))).alias("__tile"), "__s")

    # Spans that reach over whole tiles: the best of every block, then the best around every tile that has a point.
    best = lambda df, *by: df.groupBy(*by).agg(F.min_by("__s", "__order").alias("__s"), F.min("__order").alias("__order"))
    wide = spans.where(F.col("__last") - F.col("__first") > 1).select(*own[:-1], "__s", "__order", F.explode(blocks_of(F.col("__first") + 1, F.col("__last") - 1)).alias("__b"))
    wide = best(wide.select(*own[:-1], "__s", "__order", "__b.size", "__b.block"), *own[:-1], "size", "block")
    tiles = points.select(*own).crossJoin(F.broadcast(wide.select("size").distinct())).distinct().withColumn("block", F.call_function("shiftright", F.col("__tile"), F.col("size")))
    over = best(tiles.join(wide, [*own[:-1], "size", "block"]), *own)

    marks = ends.unionByName(over.select(*own, "__s")).select(
        *own, F.col("__s.start_line").cast("long").alias("__line"), F.least(F.col("__s.end_line").cast("long"), F.shiftleft("__tile", tile) + last).alias("__end"), F.lit(None).cast(points.schema["__p"].dataType).alias("__p"), "__s"
    )
    rows = marks.unionByName(points.withColumns({"__end": F.lit(None).cast("long"), "__s": F.lit(None).cast(spans.schema["__s"].dataType)}))
    # At one line spans come before points, those that end last and have the greatest keys first.
    order = [*own, "__line", F.col("__p").isNotNull(), F.desc("__s.end_line"), F.desc(f"__s.{key}")]
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return _swept(rows.repartition(parts, *own).sortWithinPartitions(*order), own).select(*[c for c in points.schema["__p"].dataType.names], *rest)


def definition_at(uses: DataFrame, symbols: DataFrame, points: DataFrame) -> DataFrame:
    """(file_path, line, key, def_path, start_line, end_line): the definitions of what is used at a line.

    ``uses`` has file_path, line and dst_key, ``symbols`` key, file_path, start_line and end_line. At a
    line where nothing is used the innermost symbol around it is its own definition.
    """
    used = points.select("file_path", "line").distinct().join(uses.select("file_path", "line", F.col("dst_key").alias("key")).distinct(), ["file_path", "line"])
    around = innermost(symbols.select("file_path", "start_line", "end_line", "key"), points.join(used, ["file_path", "line"], "left_anti").select("file_path", "line"), ["file_path"]).select("file_path", "line", "key")
    places = symbols.select("key", F.col("file_path").alias("def_path"), "start_line", "end_line")
    return used.unionByName(around).join(places, "key").select("file_path", "line", "key", "def_path", "start_line", "end_line")


def references_at(uses: DataFrame, symbols: DataFrame, points: DataFrame) -> DataFrame:
    """(file_path, line, key, ref_path, ref_line): all uses of what is used or defined at a line."""
    keys = definition_at(uses, symbols, points).select("file_path", "line", "key").distinct()
    return keys.join(uses.select(F.col("dst_key").alias("key"), F.col("file_path").alias("ref_path"), F.col("line").alias("ref_line")).distinct(), "key").select("file_path", "line", "key", "ref_path", "ref_line")
