"""The dealt queries over the given tables; :data:`SQL` has the DuckDB text where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, html_text, language_id, licences, mixing, neighbours, phrases, sharding, simhash, tokens, toxicity,
               url_templates, whitening)
from .common import table


def op1_url_templates(spark: SparkSession, folder: str) -> DataFrame:
    return url_templates.judge(table(spark, folder, "pages"))


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.groups(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_digits(F.col("fp")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


SHARD_BYTES = 32 << 20


def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(table(spark, folder, "documents"), SHARD_BYTES, columns=["doc_id"])


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.main_text(table(spark, folder, "pages"), keep=("url",)).withColumnRenamed("id", "page_id")


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))


def op7_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"))


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.count_tokens(table(spark, folder, "documents"), "word_bpe_49k.json").withColumnRenamed("id", "doc_id")


def op9_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents"))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return (mixing.mix(table(spark, folder, "documents")).drop("row", "key")
            .withColumnRenamed("id", "doc_id"))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.report(table(spark, folder, "embeddings"))


def op12_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"), top=2000)


QUERIES = {f.__name__: f for f in (op1_url_templates, op2_simhash, op3_sharding, op4_decontamination, op5_html_text, op6_toxicity, op7_neighbours, op8_token_counts, op9_licences, op10_mixing,
                                   op11_whitening, op12_language_id, op13_collocations)}
SQL: dict[str, str] = {"op9_licences": licences.oracle(), "op13_collocations": phrases.oracle()}
