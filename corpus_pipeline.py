"""A training corpus from raw documents: five stages, each written as Parquet and read again as the next one's documents.

Each stage works on all that its predecessor kept, and its decisions take effect: language ID drops what it can't tell,
near-dedup leaves one document of a class, suffix-array dedup cuts repeated passages out of the texts, mixing takes each source up to its
budget (repeating documents), and packing returns the pieces and their places in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillguard.llm import langid, mixing, neardup, packing, suffixes
from quillguard.llm.common import drop, shared_dir, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # executors have grown by then
    return packing.pack(docs, packing.default_encoder(0.3))


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mixing", mix), ("packing", pack)]

#: Alignment, suffix sorting and tokenization aren't SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. The table of each other stage is deleted once the next one's is written."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        before, out = docs, stage(spark, docs, sf_dir)
        path = f"{folder}/{k}-{name}"
        out.write.parquet(path)
        if k:
            drop(before)
        docs = spark.read.schema(out.schema).parquet(path)
        docs._stored = path
    return docs
