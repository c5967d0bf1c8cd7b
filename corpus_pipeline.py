"""Corpus pipeline: documents that a language model could train on, placed on shards.

Stages, each over everything its predecessor kept: language identification (texts without a letter, or
that no language claims, go), n-gram Jaccard join (one document of each group of near copies stays),
benchmark decontamination, mixing to target weights, and sharding.  All but the last return the columns of
``documents``: mixing returns each document as many times as it is drawn, whole copies of it by its raked
weight and none where the draw leaves it out, so that its rows meet the targets; the last adds slot and shard.  Nulls, empty
texts, repeated rows and empty tables have the results that each operator's module states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neraca.llm import decontaminate, jaccard, languages, mixing, shards
from neraca.session import cut_lineage

#: A winner that scores less than two blind two-way choices loses duels, and is no clear one among any number of languages.
LEAST_SCORE = 0.25
#: A text that blind chance explains better than every learned language is no text of any.
LEAST_AFFINITY = 0.0


def language_id(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    model = languages.fit(docs, F.col("doc_id").isNotNull() & ~languages.held_out())
    found = languages.predict(docs, model, name="__lang", score="__score", affinity="__near")
    claimed = (F.col("__lang") != "und") & (F.col("__score") >= LEAST_SCORE) & (F.col("__near") >= LEAST_AFFINITY)
    return found.filter(claimed).drop("__lang", "__score", "__near")


def near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return jaccard.one_of_each(docs, words=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    found = mixing.weighted(docs, added=("__weight", "__copies"))
    each = F.explode(F.array_repeat(F.lit(1), F.col("__copies").cast("int")))
    return found.withColumn("__each", each).drop("__weight", "__copies", "__each")


def sharded(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return shards.placed(docs)


STAGES = [
    ("language_id", language_id),
    ("near_copies", near_copies),
    ("decontaminated", decontaminated),
    ("mixed", mixed),
    ("sharded", sharded),
]

#: Support vectors, shingle sets and raking are not SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
