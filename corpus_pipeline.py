"""Corpus pipeline: language ID, exact dedup, SimHash near-dedup, benchmark decontamination, source mixing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; its result is written as parquet and read again as the next stage's docs.
All stages but the last return the columns of ``documents``; the last adds
``mix_rate`` and ``mix_copies``.  Null texts are empty: they go in the first
stage, which needs a letter.  Rows repeated in full share an id and so share
every verdict.  An empty ``documents`` table ends in an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from churnlens.llm.common import table
from churnlens.llm.decontaminate import drop_contaminated
from churnlens.llm.exact_dedup import drop_exact_duplicates
from churnlens.llm.language_id import drop_unidentified
from churnlens.llm.simhash_dedup import drop_near_duplicates
from churnlens.llm.source_mix import label_domains, mix
from churnlens.session import cut_lineage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language was found."""
    return drop_unidentified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The largest id of each set of equal texts."""
    return drop_exact_duplicates(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each component of fingerprints that differ in at most 3 bits."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix draws at least once, with rate and copies."""
    return mix(docs, label_domains(table(spark, sf_dir, "labels")))


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", decontamination),
    ("source mix", source_mix),
]

# language ID and the mix are fitted models, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
