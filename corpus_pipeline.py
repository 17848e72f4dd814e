"""The corpus pipeline: stages of the training-data operators, applied to ``documents`` one after another.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the columns of docs; the last
returns the packed pieces. The stages: drop toxic documents, drop low-quality documents, keep one document of each group of
near duplicates, take repeated passages out of the texts, pack token ids into sequences.

What a stage does with nulls, empty and very long texts, ties, repeated rows and other columns is its operator's: a null or
empty text has no toxic feature, fails the base rule of the quality rules and so ends there; a row without doc_id goes through
as any other; of repeated rows one stays after the third stage; columns that documents have besides are passed on to the last
stage, whatever their names, and an empty table gives empty tables all the way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuscle.llm import ngram_join, packing, quality, substring, toxicity
from corpuscle.llm._common import documents, stored


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(spark, docs, _labels(spark, sf_dir))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(spark, docs, _labels(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(spark, docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", remove_repeated_passages),
    ("packing", pack),
]

#: no SQL form: tests/llm holds the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written as Parquet and read again for the next stage."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(spark, docs, name.replace(" ", "_"))
    return docs
