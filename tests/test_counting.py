"""How n-grams of documents are counted, and grids made: no group by document, no product of partitions."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexispark.functions import tokens as tk
from lexispark.operators import corpus, counting, order, training
from lexispark.plans import catalogue
from lexispark.plans import fixtures as fx

DOCS = [(1, "a b a b a", "src1"), (1, "a b", "src1"), (2, "b a  b", "src1"), (3, "a b", "src2"), (None, "a b", "src2"), (4, None, "src1"), (5, " \n", "src1"), (6, "a", "src1")]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(DOCS, "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    return path


def test_counts_and_distinct_documents(spark, sf):
    assert sorted(map(tuple, fx.ng2(spark, sf).select("year", "ngram", "freq", "doc").collect())) == [(2001, "a b", 4, 2), (2001, "b a", 3, 2), (2002, "a b", 2, 1)]
    assert sorted(map(tuple, fx.ng1(spark, sf).select("year", "ngram", "freq", "doc").collect())) == [(2001, "a", 6, 3), (2001, "b", 5, 2), (2002, "a", 2, 1), (2002, "b", 2, 1)]


def _dealt(df):
    """The keys of each shuffle of a plan."""
    return re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", df._jdf.queryExecution().executedPlan().toString())


def test_pairs_are_dealt_once(spark, sf):
    for out in (corpus.totals(fx.ng2(spark, sf)), corpus.consolidate(fx.ng2(spark, sf))):
        keys = [k for k in _dealt(out) if "ngram" in k]
        assert len(keys) == 1 and "doc_id" not in keys[0]


def test_grid_is_one_partition_however_many_axes(spark):
    grid = training.parameter_grid(spark, year=[1900, 1910], weight_by=["none", "freq"], vector_size=100, epochs=[5, 10, 15])
    assert grid.rdd.getNumPartitions() == 1
    assert grid.dtypes == [("year", "bigint"), ("weight_by", "string"), ("vector_size", "bigint"), ("epochs", "bigint")]
    assert grid.count() == 12 and len(set(grid.collect())) == 12


def test_prefix_key_of_odd_tokens(spark):
    rows = [("The cat", "tc___"), ("Über x", "_x___"), ("İz 9a", "i____"), ("Ka", "k____"), ("", "_____"), ("a b c d e f", "abcde"), (None, "_____")]
    got = spark.createDataFrame([(r[0],) for r in rows], "ngram string").select("ngram", tk.prefix_key(tk.tokens("ngram"), 5).alias("k"))
    assert {r["ngram"]: r["k"] for r in got.collect()} == dict(rows)
    assert order.prefix_histogram(got, 1).count() == 5


def test_vocabulary_looks_up_what_other_tests_leave(spark):
    rows = [("Water, stone", 1, 2, 1), ("9 stone", 1, 3, 1), ("stone water", 1, 1, None), ("the of", 1, 9, 9), ("rare stone", 1, 1, 1), ("stone", 1, 1, 1)]
    ngrams = spark.createDataFrame(rows, "ngram string, year int, freq long, doc long")
    voc, spec = spark.createDataFrame([("STONE",), ("water",), ("the",)], "word string"), tk.TokenFilter(stops=("the",))
    out = corpus.filter_ngrams(ngrams, spec, 2, unk="UNK", vocabulary=voc)
    assert sorted(map(tuple, out.select("ngram", "freq", "doc").collect())) == [("UNK stone", 6, 3), ("stone water", 1, 0)]
    assert not [k for k in _dealt(out) if "token" in k and "ngram" in k]
    counts = corpus.filter_counts(ngrams, spec, 2, voc).first().asDict()
    assert counts == {"dropped_stop": 1, "dropped_short": 0, "dropped_numeral": 0, "dropped_nonalpha": 0, "dropped_vocab": 4, "dropped_ngrams": 5}


ODD = [(1, "x  y\tx\ny \r x", 1), (2, "x y", 1), (None, "x y", 1), (3, "x\x0by x\x0by   Ü", 2), (4, "", 1), (5, None, 2), (6, "y", None), (6, "z y z y", None)]


@pytest.mark.parametrize("size", [1, 2])
@pytest.mark.parametrize("chunk", [1, 1 << 20])
def test_a_batch_is_counted_as_documents_are(spark, monkeypatch, size, chunk):
    """The same sums however texts are cut into runs, and a row for each n-gram of a run, not of each document."""
    monkeypatch.setattr(counting, "CHUNK", chunk)
    want = {}
    for doc_id, year in {(d, y) for d, _, y in ODD}:
        texts = [re.split("[ \t\n\r]+", t.strip(" \t\n\r")) for d, t, y in ODD if (d, y) == (doc_id, year) and t]
        grams = [" ".join(t[i : i + size]) for t in texts for i in range(len(t) - size + 1)]
        for g in set(grams):
            n, d = want.get((year, g), (0, 0))
            want[year, g] = n + grams.count(g), d + (doc_id is not None)
    rows = counting.counted(spark.createDataFrame(ODD, "doc_id long, text string, year int").coalesce(1), size, "year").collect()
    got = {}
    for r in rows:
        n, d = got.get((r["year"], r["ngram"]), (0, 0))
        got[r["year"], r["ngram"]] = n + r["n"], d + r["d"]
    assert got == want
    assert chunk == 1 or len([r for r in rows if r["year"] == 1]) == len([k for k in want if k[0] == 1])


def test_partitions_of_pairs_follow_the_text(spark, sf, monkeypatch):
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = fx.documents(spark, sf)
    assert counting.dealt(docs.withColumn("ngram", F.col("text")), docs).rdd.getNumPartitions() <= own
    monkeypatch.setattr(counting, "DEALT", 1)
    assert counting.dealt(docs.withColumn("ngram", F.col("text")), docs).rdd.getNumPartitions() == sum(len(t or "") for _, t, _ in DOCS) > own


def test_histogram_counts_by_initials_first(spark):
    rows = [("The cat", 1), (" the\tCat ", 2), ("tiny Cow x", 4), ("9 cat", 8), ("", 16), (None, 32)]
    out = order.prefix_histogram(spark.createDataFrame(rows, "ngram string, freq long"), 3, "freq")
    assert sorted(map(tuple, out.collect())) == [("___", 2, 48), ("_c_", 1, 8), ("tc_", 2, 3), ("tcx", 1, 4)]
    assert "regexp_replace" in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("min_tokens,unk", [(2, "UNK"), (1, None)])
def test_filtered_pairs_are_dealt_once(spark, sf, tmp_path, min_tokens, unk):
    """Filters of pairs shuffle by what is left of a pair alone, with the sums that filtering the summed corpus has."""
    rows = [(1, "stone water 9 stone water", "src1"), (1, "the stone", "src1"), (2, "9 stone is water", "src1"), (3, "of stone water", "src2"), (None, "9 stone", "src2")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    name = "filter_unk" if unk else "filter_min_tokens"
    want = corpus.filter_ngrams(fx.ng2(spark, str(tmp_path)), catalogue.SPEC, min_tokens, unk=unk)
    got = catalogue.queries()[name](spark, str(tmp_path))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect())) != []
    assert len([k for k in _dealt(catalogue.queries()[name](spark, sf)) if "doc_id" not in k]) == 1


def test_words_are_not_sorted_for_their_numbers(monkeypatch):
    """Single words have numbers from the dictionary: only (word, document) and (word, keys) and keys are made distinct."""
    sorts, unique = [], np.unique
    monkeypatch.setattr(counting.np, "unique", lambda *a, **b: sorts.append(1) or unique(*a, **b))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "year": [1, 2], "texts": [["b a b"], ["a c"]]})
    out = counting._counts(batch, ["year"], 1).to_pylist()
    assert [tuple(r.values()) for r in out] == [(1, "a", 1, 1), (2, "a", 1, 1), (1, "b", 2, 1), (2, "c", 1, 1)] and len(sorts) == 3
