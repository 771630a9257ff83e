"""An inverted index of texts: postings by word and block of documents, read by word, pruned by block.

A posting names a word of a field, a block of some hundred documents, those of them that have it, and
how many they are. Postings are partitioned by a hash of the word and sorted by it, so a request reads
a few row groups of a few partitions. A block's bound is the score of a document that had all the
words that the block has: the best documents are sought in the blocks of the highest bounds, and of
the others only those whose bound reaches the score found there are opened.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass
from functools import reduce
from math import floor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.search import MatchText, boosts, idf, tokens


@dataclass(frozen=True)
class TextIndex:
    """An index in a folder: ``n`` documents, whose words lie in ``buckets`` partitions."""

    spark: SparkSession
    path: str
    n: int
    buckets: int
    id_type: str

    def postings(self) -> DataFrame:
        return self.spark.read.schema(f"field string, term string, block long, ids array<{self.id_type}>, n int, bucket int").parquet(f"{self.path}/postings")

    def of(self, fields: list[str], words: list[str]) -> DataFrame:
        """The postings of some words: no other partition is read."""
        own = sorted({bucket_of(w, self.buckets) for w in words})
        return self.postings().where(F.col("bucket").isin(own) & F.col("term").isin(words) & F.col("field").isin(fields))


def bucket_of(word: str, buckets: int) -> int:
    return zlib.crc32(word.encode()) % buckets


def build(df: DataFrame, fields: list[str], id_col: str, path: str, block: int = 128, buckets: int | None = None) -> TextIndex:
    """Index all rows; null texts have no words but count as documents. Rows with a null id are left out.

    Documents are dealt to blocks by a hash of their id. Rows that share an id are one document that
    has the words of all. A word's posting has at most a block's documents, so frequent words are
    spread over many rows and no group grows with the input. There is a bucket for every 20,000
    documents if not told otherwise, from 8 to 4,096.
    """
    rows = df.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{f}`").alias(f"f{i}") for i, f in enumerate(fields)])
    n = rows.select("id").distinct().count()
    blocks = max(1, -(-n // block))
    buckets = buckets or min(4096, max(8, n // 20_000))
    spark = df.sparkSession
    # Texts are exchanged by block, so that words are told apart and grouped where they are and do not move.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
    texts = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).repartition(parts, "block")
    of = lambda i, f: F.transform(F.array_distinct(tokens(F.coalesce(F.col(f"f{i}"), F.lit("")))), lambda t: F.struct(F.lit(f).alias("field"), t.alias("term")))
    words = texts.select("id", "block", F.explode(F.concat(*[of(i, f) for i, f in enumerate(fields)])).alias("w")).select("id", "block", "w.field", "w.term")
    postings = (
        words.where("term <> ''").groupBy("field", "term", "block").agg(F.array_sort(F.collect_set("id")).alias("ids"))
        .withColumns({"n": F.size("ids"), "bucket": F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(buckets)).cast("int")})
    )
    postings.repartition(buckets, "bucket").sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{path}/postings")
    kind = rows.schema["id"].dataType.simpleString()
    spark.createDataFrame([(json.dumps({"n": n, "buckets": buckets, "id_type": kind}),)], "about string").coalesce(1).write.text(f"{path}/about")
    return TextIndex(spark, path, n, buckets, kind)


def load(spark: SparkSession, path: str) -> TextIndex:
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    return TextIndex(spark, path, about["n"], about["buckets"], about["id_type"])


def _scores(own: DataFrame, by: str, weights: dict[tuple[str, str], float], words: list[str], fields: list[tuple[str, float]]) -> DataFrame:
    """(by, matched_terms, text_score): the words of each group of postings, and the best field's sum of their weights."""
    has = {(f, w): F.max(F.when((F.col("field") == f) & (F.col("term") == w), 1).otherwise(0)) for f, _ in fields for w in words}
    flags = own.groupBy(by).agg(*[c.alias(f"h{k}") for k, c in enumerate(has.values())])
    flag = {key: F.col(f"h{k}") for k, key in enumerate(has)}
    sums = [reduce(lambda a, b: a + b, [F.when(flag[f, w] == 1, weights[f, w]).otherwise(0.0) for w in words]) * boost for f, boost in fields]
    found = reduce(lambda a, b: a + b, [F.greatest(F.lit(0), *[flag[f, w] for f, _ in fields]) for w in words])
    return flags.select(by, found.alias("matched_terms"), F.greatest(F.lit(float("-inf")), *sums).alias("text_score"))


def scores(index: TextIndex, match: MatchText, top: int | None = None) -> DataFrame:
    """(id, matched_terms, text_score) of the documents that hold enough of the words, as ``search.text_score`` scores them.

    With ``top`` only that many of the best, equal ones by id; blocks whose bound is below the last
    of them are not opened.
    """
    words, fields, need = match.words(), boosts(match), match.needed()
    own = index.of([f for f, _ in fields], words)
    if not words:
        return own.select(F.lit(None).cast(index.id_type).alias("id"), F.lit(0).alias("matched_terms"), F.lit(0.0).alias("text_score")).where("false")
    counts = {(r["field"], r["term"]): r["n"] for r in own.groupBy("field", "term").agg(F.sum("n").alias("n")).collect()}
    weights = {(f, w): idf(index.n, counts.get((f, w), 0)) for f, _ in fields for w in words}
    of = lambda part: _scores(part.select("field", "term", F.explode("ids").alias("id")), "id", weights, words, fields).where(F.col("matched_terms") >= need)
    if top is None:
        return of(own)
    order = [F.desc("text_score"), F.col("id")]
    bounds = _scores(own.select("field", "term", "block"), "block", weights, words, fields).where(F.col("matched_terms") >= need)
    most = bounds.orderBy(F.desc("text_score"), "block").limit(max(16, top // 4)).select("block")
    best = of(own.join(F.broadcast(most), "block", "left_semi")).orderBy(*order).limit(top).agg(F.min("text_score"), F.count(F.lit(1))).first()
    if best[1] == top:  # a sum may be rounded otherwise in another order
        bounds = bounds.where(F.col("text_score") >= best[0] - 1e-9)
    return of(own.join(bounds.select("block"), "block", "left_semi")).orderBy(*order).limit(top)


def matching(index: TextIndex, df: DataFrame, match: MatchText, id_col: str) -> DataFrame:
    """The rows of ``df`` that hold enough of the words, with matched_terms and text_score; their texts are not read."""
    return df.join(scores(index, match).withColumnRenamed("id", id_col), id_col)
