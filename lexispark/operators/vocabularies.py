"""Vocabularies as sets, and joins with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def words_of(df: DataFrame, column: str = "word") -> DataFrame:
    return df.select(F.col(column).alias("word")).distinct()


def read_vocabulary(lines: DataFrame) -> DataFrame:
    """A vocabulary of raw lines: trimmed, lower case, no blanks, distinct."""
    return lines.select(F.lower(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("word")).where("word <> ''").distinct()


def keep(df: DataFrame, vocabulary: DataFrame, column: str = "word") -> DataFrame:
    """Rows whose word is in the vocabulary; Spark broadcasts it when its size allows."""
    return df.join(vocabulary.select(F.col("word").alias(column)).distinct(), column, "left_semi")


def drop(df: DataFrame, stops: DataFrame, column: str = "word") -> DataFrame:
    return df.join(stops.select(F.col("word").alias(column)).distinct(), column, "left_anti")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return words_of(a).intersect(words_of(b))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return words_of(a).union(words_of(b)).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return words_of(a).join(words_of(b), "word", "left_anti")


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two vocabularies hold the same words."""
    odd = difference(a, b).unionAll(difference(b, a))
    return odd.agg((F.count("*") == 0).alias("equal"))


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a manifest doesn't list yet."""
    return items.join(done.select(key).distinct(), key, "left_anti")
