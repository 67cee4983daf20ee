"""A corpus pipeline: from raw documents to packed sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return
the columns of ``documents``.  Stages are written to the shared folder and read again, so a lost executor
costs the stage at hand only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from partloom.llm import exact_dedup, langid, mixing, odd_sketch, packing, simhash
from partloom.llm.queries import MIX_SEED, MIX_WEIGHTS, TOKENIZER
from partloom.llm.storage import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language: those without a letter go, and those in which the network sees none."""
    return langid.drop_unidentified(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by fingerprints (op10), and of what is left one of each group linked by a similarity
    of 0.8 or more of their five-word shingles, most of which fingerprints do not show."""
    return odd_sketch.drop_near_duplicates(simhash.drop_near_duplicates(docs), width=5, similarity=0.8)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, shuffled globally."""
    return mixing.mix(docs, MIX_WEIGHTS, seed=MIX_SEED).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("sequences", sequences),
]

#: A trained network, a tokenizer and a search for near copies have no form in SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
