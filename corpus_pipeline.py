"""The corpus pipeline: documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)``, works on every row its predecessor
kept, and returns a DataFrame that is written as Parquet and read again as the
next stage's ``docs``. All stages but the last return the columns of
``documents``; the last returns one row per packed piece. No stage can be
written in SQL, so there is no ``ORACLE_SQL``; ``tests/llm/test_others.py``
holds the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.llm.common import columns_of, materialize
from hindcast.llm.langid import UNDETERMINED, identify, labelled_sample
from hindcast.llm.mixing import mixture
from hindcast.llm.packing import pack_documents
from hindcast.llm.simhash import keep_one

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; texts that are null or have no
    letter go. The automata are fitted on a bounded sample of labelled rows. If
    no text with a letter has a label, no language can be told and the texts
    with a letter stay."""
    sample = labelled_sample(docs)
    if not sample:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    told = identify(docs, sample)
    return told.filter(F.col("lang_pred") != UNDETERMINED).select(*columns_of(docs.columns))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest doc_id; of
    several rows with that id, the one whose text comes first. Texts that are
    null or have no words share one fingerprint, so one of them stays. Rows with
    a null id go before others of their group only if all its ids are null.
    Repeated rows are near duplicates of each other. An empty table stays
    empty; other columns are kept as they are."""
    return keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it: not at all, once or
    twice, so rows repeat. A null source is one source; documents without words
    have size 0 and are taken with their block. Rows that agree in id and text
    are taken alike. An empty table stays empty; other columns are kept."""
    return mixture(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of at most 1024 ids. Every row is a
    document of its own: repeated rows and null ids are packed each time they
    occur, a null or empty text as its end id alone, a very long one as several
    pieces. An empty table gives an empty result."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
