"""The corpus pipeline: quality filter, near-dedup, decontamination, mixing and sharding of ``documents``, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet into the
shared folder and rereads it as the next one's docs. All stages but the last return the columns of
``documents`` whole. Null and empty texts, repeated rows, empty tables and extra columns are defined
in the operators' modules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trainset.llm import decontaminate, mixing, quality, shards, simhash
from trainset.llm.common import materialize, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep_one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least one word in 20 comes from benchmark items go; the others lose spans of 13 such words or more."""
    return decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"), n_chars="n_chars" if "n_chars" in docs.columns else None)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Domains, languages and sources get their share of 70 % of the tokens; no document is repeated."""
    return mixing.mix_documents(docs, budget_fraction=0.7, max_epochs=1)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard, and the shard it would have with one more."""
    return shards.with_shard(docs, grown=True)


STAGES = [
    ("quality classifier", quality_filter),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mix),
    ("sharding", shard),
]

#: Fingerprints and learned scores have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
