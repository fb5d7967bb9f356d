"""A corpus pipeline: language ID, exact and near dedup, mixing, packing.

Every stage takes all that the one before kept. Extra columns are carried along
by all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, langid, mixing, ngram_join, packing
from tessera.llm.common import Workspace


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled rows name.

    A document goes if no language's profile is near: it is in another language,
    or has no letters (null and empty texts). Without any usable label no
    document goes, and a warning is given. Repeated rows are judged alike; null
    ids are never learned from; an empty table gives no rows.
    """
    return langid.in_languages(docs, langid.fit_profiles(docs)).select(*docs.columns)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that with the largest id.

    Null counts as an empty text; of rows with null ids only, one stays for each
    text; rows that repeat id and text become one; an empty table gives no rows.
    """
    return exact_dedup.deduplicated(docs).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 over five-word shingles, that with the smallest id.

    Texts without words link with nothing and stay, as do rows with a null id;
    rows that repeat an id are one document; an empty table gives no rows.
    """
    return ngram_join.one_of_each(docs, n=5, num=80, den=100, cells=2).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in random order.

    A null source is a source of its own; rows that repeat an id are repeated
    alike; an empty text weighs one byte; an empty table gives no rows.
    """
    return mixing.mix_sources(docs, extras=False)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batches of all documents that are left: the columns of ``packing.pack_lengths``.

    A text without words is one piece of length 0; null ids and repeated rows
    are rows like others; an empty table gives no rows.
    """
    return packing.pack_lengths(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", dedup_exact),
    ("ngram_join", dedup_near),
    ("mixing", mix),
    ("packing", pack),
]

#: Shingle components, rank-order profiles and the bucket programme have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again.

    A stage's input goes once its result is written, so the shared folder holds
    two of them at most. Edge cases are those of the stages.
    """
    docs, ws, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark, "pipeline"), None
    for name, stage in STAGES:
        docs = ws.stored(stage(spark, docs, sf_dir), name)
        ws.drop(before)
        before = docs
    return docs
