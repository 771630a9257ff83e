"""The corpus pipeline: quality rules, near-dedup, benchmark decontamination, secrets, packing.

Every stage takes all rows that the one before kept, as a table, and its decisions take effect:
rows go, or texts change. The last one gives the pieces of the documents, with their texts, in bins.

Stages decide about rows and not about ids, so ids may be null or repeated, and other columns may
have any names. Null and empty texts, and texts of under 50 words, go with the quality rules. Rows
that repeat are near-duplicates, of which one stays. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import decontamination, neardup, packing, rules, secrets
from codeloom.sources.scratch import discard, materialize
from codeloom.sources.tables import read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates the document with the smallest id stays, and one without an id only where there is no other."""
    return neardup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; every row is judged by its own text."""
    return decontamination.remove_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; n_chars follows the text. No row goes."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in bins of the permitted lengths, by tokens; put together, a document's pieces are its text."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: The stages learn from the corpus and iterate, which SQL does not express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared scratch folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
