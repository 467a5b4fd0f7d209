"""The corpus pipeline: language ID, n-gram Jaccard join, benchmark decontamination, PII, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written and read again as the next one's
docs. All but the last return the columns of documents, whatever other columns there are and whatever they are called.

In every stage an empty table gives an empty one, long texts are read whole, and only doc_id, text and lang (the first stage)
matter; the docstrings say what becomes of nulls, empty texts, ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from florilege.llm import decontamination, jaccard, language, packing, pii
from florilege.llm.common import materialised, table

#: Bytes of text that go to Python workers at once. A batch is held by Spark and by a worker, and by both again on its way back.
BATCH_BYTES = 8 << 20
_BATCH, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bounded(spark: SparkSession) -> None:
    """Smaller Arrow batches, as an executor of the pipeline keeps the memory that its largest stage took. A session that has a
    setting of its own keeps it."""
    if spark.conf.get(_BATCH) == _DEFAULT:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go: those too far from all centroids, and null, empty or letterless texts.

    A null lang is not learned from, but its row is judged like others; a null doc_id counts as a training id; repeated rows
    are judged each, so all stay or all go; of centroids at one cosine the first counts. Where nothing can be learned, no
    language is known and every document goes.
    """
    bounded(spark)
    return language.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id.

    Null and empty texts have no near duplicates and stay, as do rows with a null doc_id; of repeated rows one stays; rows that
    share an id but aren't near duplicates stay both; of several near duplicates with the group's smallest id one stays.
    """
    bounded(spark)
    return jaccard.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay, as do rows with a null doc_id; rows that share a doc_id are one document and go
    together, repeated rows too; an agreement of exactly the least share counts; items without words or id are passed over.
    """
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by the name of its kind; no row goes.

    Null texts stay null and empty ones empty; ids don't matter; repeated rows are changed alike; where spans overlap, the one
    that begins first names them, and of two that begin together the shorter.
    """
    return pii.redact(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents packed into token sequences, a row per piece.

    Null and empty texts are one token; a null doc_id is carried; repeated rows are packed each; pieces of one size may change
    places.
    """
    bounded(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", languages),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_leaks),
    ("pii", personal_data),
    ("best_fit_packing", sequences),
]

#: Trained centroids and the packing search have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialised(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
