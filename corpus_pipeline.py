"""A training corpus from raw documents, in stages that each read what the stage before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from houselights.llm import decontaminate, histogram_shards, mixing, quality, simhash_index
from houselights.llm.common import table
from houselights.session import scratch_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones, rejects go."""
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (SimHash of three-word shingles, 3 bits or fewer apart) stays."""
    return simhash_index.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages in a twentieth of their words or more go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are used up to MAX_REPEATS times, every document at least once."""
    return mixing.mixed(docs, mixing.Target(max_repeats=mixing.MAX_REPEATS))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sixteen shards of nearly equal bytes; every row keeps its columns."""
    return histogram_shards.digest(histogram_shards.shard_documents(docs, carry=COLUMNS[1:]))


STAGES = [
    ("quality classifier", classify),
    ("near duplicates", deduplicate),
    ("benchmark decontamination", decontaminated),
    ("source mixing", mix),
    ("sharding", shard),
]

#: The classifier, the fingerprints and the mixture have no SQL counterpart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to `documents`; each result is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        place = scratch_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return STAGES[-1][1](spark, docs, sf_dir)
