"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the
next one.  All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm import exact, mixing, near, packing, quality
from sensorloom.llm.common import free_name, kept_rows, table, written
from sensorloom.llm.queries import TARGETS, WORD_BPE


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on labelled rows of the stage's input."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    return quality.scores(docs, model, column=score).filter(F.col(score) >= quality.THRESHOLD).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact.drop_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return kept_rows(docs, near.near_groups(docs))


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rates say."""
    return mixing.mixed(docs, mixing.mix(docs, table(spark, sf_dir, "labels"), TARGETS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path(WORD_BPE))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_languages),
    ("packing", pack_sequences),
]

#: A trained network and fitted rates are beyond SQL; tests hold only columns, counts and exact dedup's distinct texts against the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
