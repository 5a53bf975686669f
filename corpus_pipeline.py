"""The corpus pipeline: documents in, token files out.

Each stage takes what its predecessor kept, written as Parquet and read again:
the quality classifier drops what it rejects, one document of each group of near
copies stays, documents that hold benchmark passages go, sources are mixed to
their target weights (a document may come up to three times), and the rest is
encoded into token files, of which the last stage returns one row per document.

Defined results: rows without an id, repeated rows, and rows of one id with different
texts are documents like others to every stage, as the stages' own modules say; a
NULL or empty text is scored, is a near copy of nothing, holds no passage, has size
0 and so is not taken by the mix; an empty table stays empty through all stages.
Columns beyond those of documents pass through the first four stages as they are,
whatever their names; the last returns its own columns only.

The classifier is fitted on the documents the first stage is given and on labels
outside the held-out fifth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontam, jaccard, mixing, quality, token_files
from plumbline.llm.common import keep_table, table

#: Near copies of the pipeline: words of a shingle, least similarity; those of op3 are its query's own.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def accepted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.deduplicated(docs, NEAR_WORDS, NEAR_PERCENT)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def weighted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.op8(docs)


STAGES = [
    ("quality classifier", accepted),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", unseen),
    ("mixing sources to target weights", weighted),
    ("token-ID / binary output", encoded),
]

#: A trained classifier and a tokenizer are not SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep_table(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
