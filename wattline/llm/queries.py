"""The corpus operators as registered queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import clustering, collocations, decontamination, line_dedup, mixing, neighbours, pii, secrets, sharding, simhash, topk, toxicity, url_rules
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op1_query(read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op2_query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op3_query(read(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op4_query(read(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.op5_query(read(spark, sf_dir, "embeddings"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op8_query(read(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.op6_query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op10_query(read(spark, sf_dir, "documents"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(read(spark, sf_dir, "pages"), url_rules.rules_frame(spark))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op9_query(read(spark, sf_dir, "documents"))


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.op11_query(read(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.op12_query(read(spark, sf_dir, "documents"))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.op13_query(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_mixing": op1_mixing,
    "op2_toxicity": op2_toxicity,
    "op3_line_dedup": op3_line_dedup,
    "op4_pii": op4_pii,
    "op5_topk": op5_topk,
    "op6_decontamination": op6_decontamination,
    "op7_url_rules": op7_url_rules,
    "op8_secrets": op8_secrets,
    "op9_sharding": op9_sharding,
    "op10_simhash": op10_simhash,
    "op11_neighbours": op11_neighbours,
    "op12_collocations": op12_collocations,
    "op13_clusters": op13_clusters,
}
