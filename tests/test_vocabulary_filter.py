"""Filtering by a vocabulary table."""

import pytest
from pyspark.sql import functions as F

from lexispark.functions import tokens as tk
from lexispark.operators import corpus
from lexispark.schema import CORPUS

ROWS = [("the Horse", 1999, 3, 1), ("horse ran", 1999, 4, 2), ("horse ran", 2000, 1, 1), ("xx a1b", 1999, 9, 9), ("", 1999, 1, 1), ("RAN far off", 2001, 2, 2), ("o'neil ran", 1999, 5, 1), ("horse  ran", 1999, 6, 3)]
WORDS = ("horse", "ran", "the", "far", "a1b", "o'neil")


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame(ROWS, CORPUS), spark.createDataFrame([(w.upper(),) for w in WORDS] + [("ran",)], "word string")


@pytest.mark.parametrize("options", [{}, {"min_tokens": 1}, {"unk": "UNK"}, {"unk": "UNK", "count_unk": False}])
def test_table_equals_inlined_words(frames, options):
    rows, vocabulary = frames
    spec, inlined = tk.TokenFilter(stops=("the",)), tk.TokenFilter(stops=("the",), vocabulary=WORDS)
    want = corpus.filter_ngrams(rows, inlined, **options)
    got = corpus.filter_ngrams(rows, spec, vocabulary=vocabulary, **options)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_counts_name_the_vocabulary_first(frames):
    rows, vocabulary = frames
    spec = tk.TokenFilter(stops=("the", "xx"))
    got = corpus.filter_counts(rows, spec, 2, vocabulary).first().asDict()
    assert got == corpus.filter_counts(rows, tk.TokenFilter(stops=("the", "xx"), vocabulary=WORDS), 2).first().asDict()
    assert got == {"dropped_stop": 1, "dropped_short": 0, "dropped_numeral": 1, "dropped_nonalpha": 1, "dropped_vocab": 2, "dropped_ngrams": 4}


def test_fused_with_a_table(spark):
    lines = spark.createDataFrame([("Horse_NOUN\t1999,3,1",), ("zebra_NOUN\t1999,3,1",), ("horse_VERB\t1999,4,2\t2000,1,1\tbad",)], "value string")
    got = corpus.fused(lines, "tagged", tk.TokenFilter(), vocabulary=spark.createDataFrame([("horse",)], "word string"))
    assert sorted(map(tuple, got.select("ngram", "year", "freq", "doc").collect())) == [("horse", 1999, 7, 3), ("horse", 2000, 1, 1)]


def test_many_words_are_a_join_not_a_list(spark):
    """500,000 words, none of them in the plan."""
    vocabulary = spark.range(500_000).select(F.concat(F.lit("w"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("word"))
    rows = vocabulary.where(F.xxhash64("word") % 50 == 0).select(F.concat("word", F.lit(" "), F.concat("word", F.lit("zz"))).alias("ngram"), F.lit(1999).alias("year"), F.lit(1).cast("long").alias("freq"), F.lit(1).cast("long").alias("doc"))
    n = rows.count()
    got = corpus.filter_counts(rows, tk.TokenFilter(min_length=0), 2, vocabulary)
    assert got.first()["dropped_vocab"] == n and got.first()["dropped_ngrams"] == n
    kept = corpus.filter_ngrams(rows, tk.TokenFilter(min_length=0), 1, vocabulary=vocabulary)
    assert kept.count() == n and len(kept._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_empty(spark, frames):
    none = spark.createDataFrame([], CORPUS)
    assert corpus.filter_ngrams(none, tk.TokenFilter(), vocabulary=frames[1]).count() == 0
    assert corpus.filter_counts(none, tk.TokenFilter(), 2, frames[1]).first()["dropped_ngrams"] == 0
    assert corpus.filter_ngrams(frames[0], tk.TokenFilter(), vocabulary=frames[1].limit(0)).count() == 0
