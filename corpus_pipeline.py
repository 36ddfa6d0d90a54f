"""From raw documents to packed sequences: five stages, each one operator of ``waymark.llm``.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and
read again as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import mixing, packing, quality, simhash, suffix
from waymark.llm.common import remove, shared_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of a passage that goes wherever it occurs twice: some thirty words.
PASSAGE = 200


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the risk-controlled rules reject go."""
    return quality.keep_good(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their SimHash the one with the least doc_id stays."""
    return simhash.keep_one(docs).select(COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of ``PASSAGE`` bytes that occur elsewhere go; broken characters at the edges go with them.

    A document of which nothing is left stays, with an empty text.
    """
    found = suffix.remove_repeats(docs, "lang", "source", length=PASSAGE, as_text=True)
    return found.withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or dropped, until sources have their weights, and shuffled."""
    return mixing.mix(docs.select(COLUMNS)).select(COLUMNS)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their tokens and their place in sequences of 2048."""
    return packing.pack(docs, ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("mixed sources", mixed_sources),
    ("packed sequences", packed_sequences),
]

#: SQL has no SimHash with XXH64, no tokenizer and no suffix order; tests/llm holds plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of ``documents``.

    Each stage's table is removed once the next one is written; the last stays. Nulls,
    ties, repeated rows and empty tables are what the stages' operators make of them: a
    null text is an empty one, which the quality rules reject; of equal documents one
    stays; an empty table gives no sequences. Columns but those of documents are left out.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
