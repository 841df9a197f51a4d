"""Cleaning and combining document tables: projections and filters, one fused stage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharewise.functions import text as tx


def fill_null_text(df: DataFrame) -> DataFrame:
    """Missing strings become one space; other types are left alone."""
    return df.na.fill(" ")


def filter_min_tokens(df: DataFrame, text: str = "text", tokens: int = 10) -> DataFrame:
    """Keep rows with at least ``tokens`` whitespace-separated tokens."""
    return df.where(F.regexp_count(F.col(text), F.lit(tx.NON_SPACE)) >= tokens)


def keep_word_tokens(df: DataFrame, text: str = "text", chars: int = 3) -> DataFrame:
    """Reduce the text to its words of at least ``chars`` characters."""
    return df.withColumn(text, tx.keep_word_tokens(text, chars))


def collapse_double_space(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, tx.collapse_double_space(text))


def drop_columns(df: DataFrame, columns: Sequence[str] = ("platform",)) -> DataFrame:
    return df.drop(*columns)


def contains_string(df: DataFrame, needle: str, column: str = "text") -> DataFrame:
    """Keep rows whose ``column`` contains ``needle``, case-sensitively."""
    return df.where(F.col(column).contains(needle))


def split_words(df: DataFrame, text: str = "text", out: str = "words") -> DataFrame:
    return df.withColumn(out, tx.split_words(text))


def language_flag(
    df: DataFrame, lang: str = "lang", base_lang: str = "dutch", out: str = "language"
) -> DataFrame:
    return df.withColumn(out, tx.language_flag(lang, base_lang))


def clean_documents(
    df: DataFrame, text: str = "text", tokens: int = 10, drop: Sequence[str] = ("platform",)
) -> DataFrame:
    """Fill nulls, drop short texts, collapse double spaces, drop columns."""
    df = filter_min_tokens(fill_null_text(df), text, tokens)
    return drop_columns(collapse_double_space(df, text), drop)


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate; missing columns become null, columns come out sorted by name."""
    joined = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return joined.select(*sorted(joined.columns))


def assign_labels(df: DataFrame, label: float, out: str = "label") -> DataFrame:
    """Every row of a source gets the source's label."""
    return df.withColumn(out, F.lit(float(label)))


def count_records(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Logical records (a quoted newline does not count twice)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
