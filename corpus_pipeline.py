"""A training corpus from raw documents: five stages, each one operator.

``run`` writes every stage as Parquet to the shared checkpoint folder and reads it
back as the next stage's documents. Every stage takes null, empty and very long
texts, repeated rows, empty tables and further columns, as its operator says.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import decontaminate, language, mixing, ngram_join, sharding
from cohortlens.llm._common import read, written

SHARDS = 16


def _rows(found: DataFrame, docs: DataFrame, *more: str) -> DataFrame:
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], *more)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (8): documents without a language (null or without a letter) go."""
    found = language.identify(docs, language.fit_documents(docs))
    return _rows(found.where(F.col("lang_pred") != language.UND), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (2): five-word shingles, similarity 0.8 or more; of each
    group the document with the smallest id stays."""
    return ngram_join.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (9): documents of which a twentieth of the words lies
    in benchmark passages go."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing (5): sources are replicated to the square root of their size."""
    return _rows(mixing.mix(docs), docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sharding (6): the columns of documents with shard and slot."""
    return _rows(sharding.shard_rows(docs, ["doc_id"], SHARDS), docs, "shard", "slot")


STAGES = [("language", keep_languages), ("near duplicates", drop_near_duplicates),
          ("decontamination", drop_contaminated), ("mixing", mix_sources), ("sharding", shard)]

#: SQL can't express the first and the last stage; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
