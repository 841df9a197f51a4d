"""From raw documents to token ids: five stages, each calling one operator of sharewise.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the
next stage's documents.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sharewise.llm import bpe, mixing, quality, simhash, suffix
from sharewise.llm import texts as batches
from sharewise.llm.queries import vocabulary
from sharewise.plans import store


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the texts labelled good keeps, each row by itself.

    A null text counts as empty; without usable labels all rows stay.
    """
    batches.small_batches(spark)
    return quality.select_rows(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash links: fingerprints of three-word shingles, two bits apart at most.

    The row with the smallest doc_id stays; rows without a doc_id all stay.
    """
    batches.small_batches(spark)
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of more than fifty words that also stand elsewhere.

    Every document stays, perhaps with less text; n_chars counts what is left.
    """
    batches.small_batches(spark)
    return suffix.remove_rows(docs, words=True, length=PASSAGE_WORDS, gram=RUN_WORDS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row up to three times, or not at all.

    A null source is a source of its own; empty texts are taken by chance.
    """
    batches.small_batches(spark)
    return mixing.mix_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded bytes, for every row; a null text has no ids."""
    batches.small_batches(spark)
    path, pattern = vocabulary()
    decoded = bpe.round_trip(docs, path, pattern)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


#: A passage of more than fifty words has a string of so many words.
PASSAGE_WORDS = 51

#: Words of the runs by which strings meet.
RUN_WORDS = 16

STAGES = [
    ("quality", keep_quality),
    ("near_copies", keep_one_copy),
    ("repeats", cut_repeats),
    ("mixing", mix_sources),
    ("tokens", tokens),
]

#: The first stage fits a model and the fourth draws a sample: not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
