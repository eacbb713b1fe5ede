"""A training corpus from raw documents: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import decontaminate, mixing, near_copies, sharding, toxicity
from gleaner.llm.common import table
from gleaner.session import materialize, small_batches

SHARD_BYTES = 32 << 20


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones, does not reject."""
    with small_batches(spark):
        return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    with small_batches(spark):
        return near_copies.dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    with small_batches(spark):
        return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_bytes, shard, shard_bytes, shard_docs) of every row."""
    return sharding.shard(docs, SHARD_BYTES, columns=["doc_id", "source"])


STAGES = [("toxicity", reject_toxic), ("near_dedup", drop_near_copies), ("decontamination", drop_contaminated),
          ("mixing", mix_sources), ("sharding", assign_shards)]

# A trained classifier, min-hash buckets and alignments are not SQL; the tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
