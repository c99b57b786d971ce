"""Hand-written rows: truth tables, ties, malformed input, invariants."""

import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexispark.functions import tokens as tk
from lexispark.functions.vectors import norm
from lexispark.operators import corpus, order, series, training, vectors, vocabularies
from lexispark.plans import catalogue
from lexispark.sources import text as src
from lexispark.streaming import incremental

SF = "/root/testdata/sf0.001"
STOP = tk.TokenFilter(stops=("the", "of"))


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(("ngram", "tagged", "untagged"), [
    ("cat_NOUN dog_VERB", True, False), ("cat dog", False, True), ("cat_NOUN dog", False, False), ("a_NOUNish b", False, False), ("x_Xbox", False, False), ("cat_PRT", False, True),
    ("a_NOUN  b_VERB", False, False), ("a_NOUNb_VERB", True, False), ("._.", True, False), ("_NOUN_", False, False), ("_X", False, False), ("", False, True), ("a_NOUN ", True, False), (" cat", False, False),
])
def test_ngram_types(spark, ngram, tagged, untagged):
    assert (one(spark, ngram, tk.is_tagged), one(spark, ngram, tk.is_untagged)) == (tagged, untagged)


def test_unknown_type_raises():
    with pytest.raises(ValueError, match="n-gram type"):
        tk.ngram_type("odd")


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_parse_strict_and_tolerant(spark):
    raw = lines(spark, "a_NOUN b_VERB\t1999,3,2\t2001,5,1", "a_NOUN\t1999,3,2\tbad", "a_NOUN", "foo\t1999,1,1", "foo_bar_NOUN\t2000,1,1", "")
    good, bad = corpus.parse_strict(raw)
    rows = {tuple((t["word"], t["pos"]) for t in r["tokens"]): (r["freq_tot"], r["doc_tot"]) for r in good.collect()}
    assert rows == {(("a", "NOUN"), ("b", "VERB")): (8, 3), (("a", "NOUN"),): (0, 0), (("foo_bar", "NOUN"),): (1, 1), (): (0, 0)}
    assert sorted(r["value"] for r in bad.collect()) == ["a_NOUN\t1999,3,2\tbad", "foo\t1999,1,1"]
    got = corpus.parse_tolerant(raw).collect()
    assert sorted((r["ngram"], r["freq_tot"]) for r in got) == [("a_NOUN", 3), ("a_NOUN b_VERB", 8), ("foo", 1), ("foo_bar_NOUN", 1)]
    assert [r["ngram"] for r in corpus.parse_tolerant(raw, "untagged").collect()] == ["foo"]


def test_known_tags_only(spark):
    assert tuple(one(spark, "foo_bar", tk.split_known_tag)) == ("foo_bar", None) and tuple(one(spark, "a_b_X", tk.split_known_tag)) == ("a_b", "X")


@pytest.mark.parametrize(("token", "reason"), [("the", "stop"), ("ab", "short"), ("a1b", "numeral"), ("o'neil", "nonalpha"), ("horse", None), ("The", "stop")])
def test_filter_reasons(spark, token, reason):
    assert one(spark, token, STOP.reason) == reason


def test_first_failing_test_wins(spark):
    assert one(spark, "a1", tk.TokenFilter(vocabulary=("horse",)).reason) == "vocab"


@pytest.mark.parametrize(("ngram", "options", "want"), [
    ("horse the", {"unk": "UNK"}, "horse UNK"), ("horse the", {"unk": "UNK", "count_unk": False}, None), ("the of", {"unk": "UNK"}, None), ("horse the cart", {}, "horse cart"), ("horse the", {}, None), ("horse the", {"min_tokens": 1}, "horse"),
])
def test_filtered(spark, ngram, options, want):
    assert one(spark, ngram, lambda c: tk.filtered(tk.tokens(c), STOP, **options)) == want


def test_normalised_key(spark):
    assert one(spark, "The_DET Cat_NOUN x1", lambda c: tk.normalised_key(c, lower=True, alpha=True, shorts=3)) == "the cat <UNK>"
    assert one(spark, "ran_VERB ran cats_NOUN", lambda c: tk.normalised_key(c, lemmas={("ran", "v"): "run", ("cats", "n"): "cat"})) == "run ran cat"


def test_log_weight(spark):
    got = spark.createDataFrame([(x,) for x in (0, 9, 98, 99, 999, 9999)], "f long").select(tk.log_weight(F.col("f")).alias("w")).collect()
    assert [r["w"] for r in got] == [1, 1, 1, 2, 2, 4]


def test_prefix_key(spark):
    assert one(spark, "apple 9x", lambda c: tk.prefix_key(tk.tokens(c), 3)) == "a__"


CORPUS = "ngram string, year int, freq long, doc long"


def test_consolidate_is_idempotent_and_keeps_mass(spark):
    rows = spark.createDataFrame([("a", 1999, 3, 1), ("a", 1999, 4, 2), ("a", 2000, 5, None), ("A", 1999, 1, 1)], CORPUS)
    once = corpus.consolidate(rows)
    assert sorted(map(tuple, once.collect())) == [("A", 1999, 1, 1), ("a", 1999, 7, 3), ("a", 2000, 5, 0)]
    assert sorted(map(tuple, corpus.consolidate(once).collect())) == sorted(map(tuple, once.collect()))
    assert corpus.nested(rows).where("ngram = 'a'").first()["freq_tot"] == 12
    assert tuple(corpus.lowercase_report(rows).first()) == (2, 1, 1)
    assert sorted(map(tuple, corpus.lowercase(rows).collect())) == [("a", 1999, 8, 4), ("a", 2000, 5, 0)]


def test_orders(spark):
    t = spark.createDataFrame([("c", 9), ("b", 5), ("a", 5), ("z", 70_000), ("y", 70_001)], "ngram string, freq_tot long")
    want = ["y", "z", "c", "a", "b"]
    assert [r["ngram"] for r in order.dense_index(t).orderBy("idx").collect()] == want and [r["idx"] for r in order.dense_index(t).orderBy("idx").collect()] == [1, 2, 3, 4, 5]
    assert [r["ngram"] for r in order.top_vocabulary(t, 3).orderBy("idx").collect()] == want[:3]
    assert [r["ngram"] for r in order.head_slice(t, ["ngram"], 2, 3).collect()] == ["b", "c"]
    s = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "i int, k string")
    assert order.is_sorted(s, "k", "i").first()[0] and not order.is_sorted(s, "k", "i", descending=True).first()[0]
    assert not order.is_sorted(s.withColumn("k", F.when(F.col("i") > 1, F.col("k"))), "k", "i").first()[0]
    assert [r["ngram"] for r in order.global_sort(spark.createDataFrame([("apple bat",), ("ant cat",), ("Bee",)], "ngram string")).collect()] == ["ant cat", "apple bat", "Bee"]
    assert order.sample(t, "ngram", 3, 1).count() == 3 and order.sample(t, "ngram", 9, 1).count() == 5
    assert order.sample(t.repartition(5), "ngram", 3, 1).collect() == order.sample(t, "ngram", 3, 1).collect()


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=2), st.integers(1, 10_000)), min_size=1, max_size=30, unique_by=lambda x: x[0]))
def test_dense_index_equals_one_sort(spark, rows):
    got = order.dense_index(spark.createDataFrame(rows, "ngram string, freq_tot long")).orderBy("idx").collect()
    assert [r["ngram"] for r in got] == [n for n, _ in sorted(rows, key=lambda x: (-x[1], x[0]))]


def test_last_wins_and_manifest(spark):
    rows = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("j", 1, "only")], "k string, seq int, v string")
    assert sorted(map(tuple, corpus.last_wins(rows, ["k"], ["seq"]).collect())) == [("j", 1, "only"), ("k", 2, "new")]
    files = spark.createDataFrame([("a",), ("b",)], "file string")
    assert [r["file"] for r in vocabularies.pending(files, files.where("file = 'a'"), "file").collect()] == ["b"]
    assert sorted(r["word"] for r in vocabularies.read_vocabulary(lines(spark, " The\t", "", "the", "Cat")).collect()) == ["cat", "the"]


def vecs(spark, rows):
    return spark.createDataFrame(rows, "year int, word string, vec array<float>")


def test_vectors(spark):
    v = vecs(spark, [(1900, "a", [3.0, 4.0]), (1900, "b", [1.0, 0.0]), (1910, "a", [3.0, 4.0]), (1930, "a", [4.0, 3.0])])
    u = vectors.normalise(v)
    got = {r["year"]: r for r in vectors.yearly_drift(u).collect()}
    assert set(got) == {1910, 1930} and abs(got[1910]["drift"]) < 1e-6 and abs(got[1930]["drift"] - 0.04) < 1e-6 and got[1930]["error"] == 0
    with pytest.raises(ValueError, match="error_type"):
        vectors.yearly_drift(u, error_type="odd")
    assert {r["year"]: r["relatedness"] for r in vectors.relatedness(u, "a").collect()} == pytest.approx({1900: 0.6, 1910: 0.0, 1930: 0.0}, abs=1e-6)
    assert all(r["is_normalized"] for r in vectors.normalised_report(u).collect()) and not any(r["is_normalized"] for r in vectors.normalised_report(v.where("word = 'a'")).collect())


def test_weat(spark):
    same = vecs(spark, [(1, w, [1.0, 0.0]) for w in "abcdef"])
    r = vectors.weat(same, (["a", "b"], ["c"]), (["d"], ["e", "missing"]), permutations=5).first()
    assert np.isnan(r["effect"]) and r["p"] is None
    rng = np.random.default_rng(0)
    rows = [(1, w, rng.standard_normal(4).tolist()) for w in "abcdefgh"]
    args = (vecs(spark, rows), (["a", "b"], ["c", "d"]), (["e", "f"], ["g", "h"]))
    p = vectors.weat(*args, permutations=50, seed=1).first()
    assert 0 < p["p"] <= 1 and p == vectors.weat(*args, permutations=50, seed=1).first()


def test_training_puts_like_words_together(spark):
    rows = [(f"{a} {b}", 2000, 50, 5) for a in ("cat", "dog") for b in ("purrs", "runs", "eats")] + [(f"{a} {b}", 2000, 50, 5) for a in ("stone", "rock") for b in ("lies", "falls", "breaks")]
    pairs = training.cooccurrences(spark.createDataFrame(rows, CORPUS), 2, "freq")
    for approach in ("skip-gram", "CBOW"):
        out = training.train(pairs, vector_size=8, approach=approach, epochs=150, rate=0.1)
        sims = {(r["word1"], r["word2"]): r["similarity"] for r in vectors.word_cosine(out, spark.createDataFrame([("cat", "dog"), ("cat", "stone")], "word1 string, word2 string")).collect()}
        assert sims["cat", "dog"] > sims["cat", "stone"] + 0.2
        assert out.collect() == training.train(pairs, vector_size=8, approach=approach, epochs=150, rate=0.1).collect()


def s(spark, rows):
    return spark.createDataFrame(rows, "year int, value double")


def test_series(spark):
    got = series.interpolate(s(spark, [(1900, 1.0), (1902, 3.0)]), 1899, 1903).orderBy("year").collect()
    assert [r["value"] for r in got] == [1, 1, 2, 3, 3]
    assert sorted(map(tuple, series.chunk_mean(s(spark, [(1, 1.0), (2, 3.0), (3, 8.0)]), 2).collect())) == [(1.5, 2.0), (3.0, 8.0)]
    line = s(spark, [(1900 + 2 * i, 3.0 * i) for i in range(15)])
    assert all(abs(r["value"] - 1.5) < 1e-9 for r in series.savgol_derivative(line).collect())
    assert series.savgol_derivative(line.limit(10)).count() == 0
    flat = series.gaussian(s(spark, [(i, 4.0) for i in range(3)])).collect()
    assert all(abs(r["value"] - 4) < 1e-12 for r in flat)


def test_model_names(spark):
    m = spark.createDataFrame([("w2v_y2019_wbdoc_freq_vs200_w5_mc50_sg1_e8.kv",), ("odd",)], "model string")
    assert [tuple(r)[1:] for r in training.parse_model_name(m).collect()] == [(2019, "doc_freq", 200, 5, 50, "skip-gram", 8), (None,) * 7]


def test_sources(spark, tmp_path):
    layout = src.Layout(str(tmp_path), 2)
    names = ["2-00001-of-00003.gz", "2-00000-of-00003.gz", "x.txt", "2-00002-of-00003.gz", "1-00000-of-00001.gz"]
    assert src.select_shards(names, layout, (1, 2)) == ["2-00001-of-00003.gz", "2-00002-of-00003.gz"]
    with pytest.raises(ValueError, match="file range"):
        src.select_shards(names, layout, (0, 3))
    body = b'{"ngram":"a b","freq_tot":3,"doc_tot":1,"frequencies":[{"year":1999,"freq":3,"doc":1}]}\n\n{"ngram":"c"'
    for name, data in (("a.lz4", body), ("empty.lz4", b"")):
        with pa.CompressedOutputStream(str(tmp_path / name), "lz4") as out:
            out.write(data)
    (tmp_path / "zero.lz4").write_bytes(b"")
    (tmp_path / "broken.lz4").write_bytes((tmp_path / "a.lz4").read_bytes()[:-9] + b"xxxxxxxxx")
    got = src.read_lz4_jsonl(spark, [str(tmp_path / f"{n}.lz4") for n in ("a", "empty", "zero")]).where("frequencies is not null").collect()
    assert [(r["ngram"], r["frequencies"][0]["freq"]) for r in got] == [("a b", 3)]
    assert {r["file"].rsplit("/")[-1]: r["valid"] for r in src.valid_lz4(spark, str(tmp_path / "*.lz4")).collect()}["broken.lz4"] is False
    for width in (4, 8):
        packed = spark.createDataFrame([(bytearray(src.pack_triples([(1999, 3, 2), (2001, 2**31 + 5, 1)], width)),), (bytearray(b""),)], "value binary")
        assert [[tuple(y) for y in r["years"]] for r in src.unpack_triples(packed, width=width).collect()] == [[(1999, 3, 2), (2001, 2**31 + 5, 1)], []]
    assert struct.unpack("<3Q", src.pack_triples([(1, 2, 3)])) == (1, 2, 3)
    rows = spark.createDataFrame([("a", 1999, 3, 1)], CORPUS)
    corpus.yearly(rows, f"{layout.yearly}")
    assert spark.read.parquet(layout.yearly).where("year = 1999").count() == 1
    src.write_jsonl(corpus.nested(rows), f"{tmp_path}/j")
    assert src.read_jsonl(spark, f"{tmp_path}/j").first()["freq_tot"] == 3


def test_queries_without_sql(spark):
    q = catalogue.queries()
    drawn = q["weat_permutations"](spark, SF).collect()
    assert drawn and all(r["p"] is None or 0 <= r["p"] <= 1 for r in drawn)
    assert q["procrustes_align"](spark, SF).where("abs(length - 1) > 0.001").count() == 0
    assert q["alignment_report"](spark, SF).where("orthogonality > 1e-8 or residual_after > residual_before + 1e-9").count() == 0
    trained = q["w2v_train"](spark, SF)
    assert trained.where(F.isnan(norm(F.col("vec"))) | (norm(F.col("vec")) == 0)).count() == 0 and trained.count() > 0
