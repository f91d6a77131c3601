"""A corpus pipeline of five stages over documents.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of
``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import decontaminate, jaccard, packing, quality_rules, suffixes
from gleanery.llm.queries import tokenizer_path
from gleanery.queries.common import table
from gleanery.session import cut_lineage, tune


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep to the rules and to their language's histograms."""
    tune(spark)
    return quality_rules.keep(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of similar ones."""
    tune(spark)
    return jaccard.one_of_each(docs)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document holds."""
    tune(spark)
    return suffixes.without_repeats(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    tune(spark)
    return decontaminate.keep(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences that training reads, without their ids."""
    tune(spark)
    return packing.pack(docs, tokenizer_path()).drop("ids")


STAGES = [
    ("quality rules", rules_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("suffix-array dedup", passages_stage),
    ("benchmark decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: Histogram distances, hashes of passages and a tokenizer's ids have no plain SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
