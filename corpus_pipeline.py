"""A corpus pipeline of five stages over ``documents``.

Language ID drops what it rejects, SimHash near-dedup keeps one document of
each linked group, decontamination drops documents that hold a benchmark item,
mixing draws each source to its target, and sharding deals the rest into
shuffled shards. Each stage's result is written as Parquet to the shared
folder and read again by the next. Stages handle nulls, empty texts, repeated
rows and empty tables as their operators say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm import decontaminate, language_id, mixing, sharding, simhash_dedup
from chunkloom.llm.common import checkpoint_dir, drop_folder, table

#: Share of known n-grams below which a text is in none of the learned languages: texts of the test tables have 0.9 or more,
#: other scripts and random letters 0.15 to 0.76. And the probability below which none of them stands out; texts of one
#: repeated word can score under 0.5.
LEAST_KNOWN, LEAST_SCORE = 0.8, 0.3
SHARDS = 24


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language; a text without a letter has none."""
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    known = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("lang_known") >= LEAST_KNOWN) & (F.col("lang_score") >= LEAST_SCORE)
    return language_id.identify(docs, model).where(known).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash_dedup.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix takes, a row each."""
    return mixing.expand(mixing.mix(docs))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and their slot in it."""
    return sharding.shard(docs, shards=SHARDS)


STAGES = [("language_id", identify), ("simhash_dedup", deduplicate), ("decontaminate", decontaminated), ("mixing", mixed), ("sharding", sharded)]

#: SimHash and the learned model can't be expressed in SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    folder = f"{checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:  # the stage before it has been read in full
            drop_folder(spark, f"{folder}/{k - 1}")
    return docs
