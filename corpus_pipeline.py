"""Documents to training sequences: rules, exact and near copies, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs; ``run`` chains them. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesmith.llm import exact_dedup, mixing, near_dedup, packing, quality
from cuesmith.llm.common import discard, settled, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps, by a ledger that is written beside them."""
    rows, entry = quality.judged(docs)
    rows = stored(rows, "ledger")
    return rows.where(quality.passes(quality.POLICIES["v1"], F.col(f"{entry}.failed"))).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, of the largest id."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group linked at 80 % of five-word shingles."""
    return near_dedup.drop_near_copies(docs, near_dedup.Sketch(words=5, percent=80))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, shard by shard and shuffled within each; a
    document taken twice is there twice."""
    return mixing.shuffled(mixing.mix(docs)).select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences: each piece of each document with its text and its
    place, a sequence's pieces one after another."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("exact_copies", exact_copies), ("near_copies", near_copies), ("source_mix", source_mix), ("packed_sequences", packed_sequences)]

#: Sketches and hash permutations have no SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what a stage wrote on its way, and what the
    next one has read, is deleted."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
