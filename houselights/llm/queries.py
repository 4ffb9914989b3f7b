"""One query for each corpus operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from houselights.llm import (
    decontaminate, dual_tree, histogram_shards, licence_rules, line_rules, mixing, personal_data, planes, quality, resample,
    simhash_index, suffix_dedup, token_counts)
from houselights.llm.common import table
from houselights.session import scratch_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
STATEMENTS: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            STATEMENTS[fn.__name__] = sql
        return fn
    return register


@query()
def op1_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(table(spark, sf_dir, "documents"))


@query()
def op2_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_index.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query(histogram_shards.ORACLE_SQL)
def op4_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_shards.digest(histogram_shards.shard_documents(table(spark, sf_dir, "documents")))


@query(decontaminate.ORACLE_SQL)
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query()
def op6_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_rows(table(spark, sf_dir, "documents"), mixing.Target(max_repeats=mixing.MAX_REPEATS))


@query()
def op7_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


@query(licence_rules.ORACLE_SQL)
def op8_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_rules.scan(table(spark, sf_dir, "documents"))


@query()
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find(table(spark, sf_dir, "documents"))


@query()
def op10_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query()
def op11_plane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = planes.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    return planes.round_trip(table(spark, sf_dir, "documents"), scratch_folder(spark, "planes"), vocabulary)


@query(resample.ORACLE_SQL)
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(dual_tree.ORACLE_SQL)
def op13_dual_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.digest(table(spark, sf_dir, "embeddings"))
