"""Evaluation of models, its files, training by context windows, order of whole tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.operators import evaluation, order, series, training, vectors
from lexispark.schema import EVALUATION
from lexispark.sources import text


def model(spark, name, seed):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(name, f"w{i}", [float(x) for x in rng.standard_normal(8)]) for i in range(1, 13)], "model string, word string, vec array<float>")


def test_evaluation_scores_skips_and_appends(spark, tmp_path):
    pairs = spark.createDataFrame([("w1", "w2", 7.5), ("w3", "w4", 2.0), ("w5", "w6", 9.1), ("w7", "none", 1.0)], "word1 string, word2 string, score double")
    questions = spark.createDataFrame([("w1", "w2", "w3", "w4"), ("w5", "w6", "w7", "none")], "a string, b string, c string, d string")
    a, b = model(spark, "w2v_y1900_a.kv", 1), model(spark, "w2v_y1910_b.kv", 2)
    first = evaluation.evaluate_into(str(tmp_path / "s"), a, pairs, questions)
    vecs = {r["word"]: np.array(r["vec"], float) for r in a.collect()}
    cos = lambda x, y: vecs[x] @ vecs[y] / np.linalg.norm(vecs[x]) / np.linalg.norm(vecs[y])
    ranks = [np.argsort(np.argsort(x)) for x in ([7.5, 2.0, 9.1], [cos("w1", "w2"), cos("w3", "w4"), cos("w5", "w6")])]
    unit = {w: v / np.linalg.norm(v) for w, v in vecs.items()}
    goal = unit["w2"] - unit["w1"] + unit["w3"]
    guess = max((w for w in unit if w not in ("w1", "w2", "w3")), key=lambda w: goal @ unit[w])
    row = first.first()
    assert row["similarity_score"] == pytest.approx(np.corrcoef(*ranks)[0, 1]) and row["analogy_score"] == float(guess == "w4")
    both = evaluation.evaluate_into(str(tmp_path / "s"), a.withColumn("vec", F.transform("vec", lambda x: -x * x)).union(b), pairs, questions)
    got = {r["model"]: r for r in both.collect()}
    assert set(got) == {"w2v_y1900_a.kv", "w2v_y1910_b.kv"} and got["w2v_y1900_a.kv"]["similarity_score"] == row["similarity_score"]
    assert evaluation.evaluate(a.limit(0), pairs, questions).count() == 0
    lone = evaluation.evaluate(a.where("word = 'w1'"), pairs, questions).first()
    assert lone["similarity_score"] is None and lone["analogy_score"] is None


def test_evaluation_files(spark, tmp_path):
    (tmp_path / "pairs.tsv").write_text("# word pairs\nTiger\tCat\t7.35\nbad line\nking\tqueen\t8.58\n")
    assert [tuple(r) for r in text.read_word_pairs(spark, str(tmp_path / "pairs.tsv")).orderBy("word1").collect()] == [("king", "queen", 8.58), ("tiger", "cat", 7.35)]
    (tmp_path / "q.txt").write_text(": capitals\nAthens Greece Oslo Norway\nonly three words\n")
    assert [tuple(r) for r in text.read_analogies(spark, str(tmp_path / "q.txt")).collect()] == [("athens", "greece", "oslo", "norway")]
    (tmp_path / "b.tsv").write_text("ab\t3\nzz\tx\n")
    assert [tuple(r) for r in text.read_buckets(spark, str(tmp_path / "b.tsv")).collect()] == [("ab", 3)]
    (tmp_path / "models").mkdir()
    for name in ("w2v_y1910_x.kv", "w2v_y1900_x.kv", "notes.txt"):
        (tmp_path / "models" / name).write_text("x")
    assert [(r["model"], r["year"]) for r in text.model_files(spark, str(tmp_path / "models")).orderBy("year").collect()] == [("w2v_y1900_x.kv", 1900), ("w2v_y1910_x.kv", 1910)]
    v = spark.createDataFrame([("a", 5, 1), ("b", 3, 2)], "ngram string, freq_tot long, idx long")
    text.write_vocabulary(v, str(tmp_path / "v"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "v" / "match_list")).collect()) == ["a", "b"]
    assert spark.read.parquet(str(tmp_path / "v" / "lookup")).count() == 2


def test_cbow_reads_whole_windows(spark):
    corpus = spark.createDataFrame([("a b c", 1900, 9, 1), ("a b c", 1900, 99, 1), ("a rare b", 1900, 1, 1)], "ngram string, year int, freq long, doc long")
    got = {(r["word"], tuple(r["context"])): r["n"] for r in training.context_windows(corpus, 1, "freq", min_count=2).collect()}
    assert got == {("a", ("b",)): 3.0, ("b", ("a", "c")): 3.0, ("c", ("b",)): 3.0}
    out = training.train(training.context_windows(corpus, 1, "freq", min_count=2), vector_size=4, approach="CBOW", epochs=2).collect()
    assert sorted(r["word"] for r in out) == ["a", "b", "c"] and all(np.isfinite(r["vec"]).all() for r in out)


@pytest.mark.parametrize("parts", (1, 5))
def test_order_of_a_whole_table(spark, parts):
    rows = spark.range(1000).select(F.col("id").alias("pos"), F.floor(F.col("id") / 3).alias("k")).repartition(parts)
    ask = lambda df, **k: order.is_sorted(df, "k", "pos", **k).first()["is_sorted"]
    assert ask(rows) and not ask(rows, descending=True) and ask(rows.limit(0))
    for at in (1, 500, 999):
        assert not ask(rows.withColumn("k", F.when(F.col("pos") == at, -1).otherwise(F.col("k"))))
        assert not ask(rows.withColumn("k", F.when(F.col("pos") != at, F.col("k"))))


def test_many_series_at_once(spark):
    one = spark.range(30).select(F.col("id").cast("int").alias("year"), (F.col("id") * F.col("id") % 17).cast("double").alias("value"))
    two = one.withColumn("g", F.lit("a")).union(one.withColumn("value", -F.col("value")).withColumn("g", F.lit("b")))
    for f in (lambda s, **k: series.gaussian(s, 2.0, **k), lambda s, **k: series.savgol_derivative(s, **k), lambda s, **k: series.chunk_mean(s, 4, **k)):
        rows = lambda df, sign=1: sorted((r["year"] if "year" in df.columns else r["centre"], round(sign * r["value"], 9) + 0.0) for r in df.collect())
        got = f(two, by=["g"])
        assert rows(f(one)) == rows(got.where("g = 'a'")) == rows(got.where("g = 'b'"), -1)


def test_dense_index_of_a_million_equal_frequencies(spark):
    """One frequency and one beginning: ranges are cut by the whole order, so no range holds much more than its share."""
    rows = spark.range(1_000_000).select(F.concat(F.lit("of the "), F.lpad(F.col("id").cast("string"), 7, "0")).alias("ngram"), F.lit(3).alias("freq_tot"), F.col("id"))
    out = order.dense_index(rows.union(spark.createDataFrame([("zz", 9, -1), ("a", 1, -2)], "ngram string, freq_tot int, id long")))
    assert out.where("id >= 0 and idx <> id + 2 or id = -1 and idx <> 1 or id = -2 and idx <> 1000002").count() == 0
    assert out.count() == out.select("idx").distinct().count() == 1_000_002


def test_grid_has_zero_where_a_pair_is_missing(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "a", 4.0), (2, "b", 5.0), (2, None, 7.0), (3, "a", None)], "x int, y string, m double")
    want = [(1, 3.0, 0.0), (2, 0.0, 5.0), (3, 0.0, 0.0)]
    assert [tuple(r) for r in series.grid(df, "m", "x", "y").orderBy("x").collect()] == want
    assert [tuple(r) for r in series.grid(df, "m", "x", "y", ["a", "b"]).orderBy("x").collect()] == want
    assert series.grid(df.limit(0), "m", "x", "y").count() == 0


def test_evaluation_rows_have_parameters_and_failures(spark):
    name = "w2v_y2019_wbdoc_freq_vs200_w5_mc50_sg0_e8.kv"
    scores = spark.createDataFrame([(name, 0.5, None), ("odd", 0.1, 0.2)], "model string, similarity_score double, analogy_score double")
    failed = spark.createDataFrame([(name.replace("2019", "1900"), "no such file")], "model string, error string")
    got = {r["year"]: tuple(r)[1:] for r in evaluation.evaluation_rows(scores, failed).collect()}
    assert got == {2019: (2019, "doc_freq", 200, 5, 50, "CBOW", 8, 0.5, None, None), 1900: (1900, "doc_freq", 200, 5, 50, "CBOW", 8, None, None, "no such file")}
    assert evaluation.evaluation_rows(scores).columns == EVALUATION.names


def test_nearest_to_goals_equals_one_product(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(500)] + ["x1", "x2"]
    vecs = rng.standard_normal((502, 12)).astype(np.float32)
    vecs[501] = vecs[500]  # equal vectors: the last word wins
    rows = [(y, w, [float(x) for x in v * (y - 1898)]) for y in (1900, 1901) for w, v in zip(words, vecs, strict=True) if not (y == 1901 and w == "w3")]
    questions = [(f"w{a}", f"w{b}", f"w{c}", f"w{d}") for a, b, c, d in rng.integers(0, 60, (80, 4)).tolist()] + [("w1", "w1", "x1", "w5"), ("w1", "w2", "w9", "missing")]
    got = vectors.nearest_to_goals(spark.createDataFrame(rows, "year int, word string, vec array<float>"), spark.createDataFrame(questions * 2, "a string, b string, c string, d string"), slices=3, block=7)
    u = (vecs / np.linalg.norm(vecs.astype(float), axis=1, keepdims=True)).astype(np.float32).astype(float)
    at = {w: i for i, w in enumerate(words)}
    want = {}
    for y in (1900, 1901):
        for q in set(questions):
            if any(w not in at or (y == 1901 and w == "w3") for w in q):
                continue
            s = u @ (u[at[q[1]]] - u[at[q[0]]] + u[at[q[2]]])
            want[y, *q] = max((w for w in words if w not in q[:3] and not (y == 1901 and w == "w3")), key=lambda w: (round(s[at[w]], 9), w))
    assert {tuple(r)[:5]: r["guess"] for r in got.collect()} == want


def test_all_splits_against_brute_force(spark):
    import itertools

    rng = np.random.default_rng(6)
    vecs = {w: rng.standard_normal(5) for w in "abcdefghij"}
    df = spark.createDataFrame([(1900, w, v.astype(np.float32).tolist()) for w, v in vecs.items()] + [(1910, w, [1.0] * 5) for w in vecs], "year int, word string, vec array<float>")
    sets = (["a", "b", "c"], ["d", "e", "none"]), (["f", "g"], ["h", "i", "j"])
    got = {r["year"]: r for r in vectors.weat_exact(df, *sets).collect()}
    cos = lambda x, y: vecs[x] @ vecs[y] / np.linalg.norm(vecs[x]) / np.linalg.norm(vecs[y])
    part = {t: np.mean([cos(t, w) for w in "fg"]) - np.mean([cos(t, w) for w in "hij"]) for t in "abcde"}
    diff = lambda own: np.mean([part[t] for t in own]) - np.mean([part[t] for t in part if t not in own])
    splits = [diff(x) for x in itertools.combinations("abcde", 3)]
    assert got[1900]["p"] == pytest.approx(np.mean([s >= diff("abc") - 1e-9 for s in splits])) and got[1900]["effect"] == pytest.approx(vectors.weat(df, *sets).where("year = 1900").first()["effect"])
    drawn = vectors.weat(df.where("year = 1900"), *sets, permutations=2000, seed=1).first()["p"]
    assert drawn == pytest.approx(got[1900]["p"], abs=0.05)
    with pytest.raises(ValueError, match="too many splits"):
        vectors.weat_exact(df, ([str(i) for i in range(10)], [str(i) for i in range(10, 20)]), sets[1])


def test_band_fills_missing_deviations(spark):
    nan, z = float("nan"), 1.959963984540054
    rows = [(1900, 1.0, 2.0), (1901, 3.0, nan), (1902, nan, 0.0), (1903, 5.0, 4.0), (1904, 7.0, None)]
    scores = spark.createDataFrame(rows, "year int, effect double, sd double")
    got = [tuple(r) for r in vectors.association_band(scores).orderBy("centre").collect()]
    assert [g[0] for g in got] == [1900, 1901, 1902, 1903, 1904] and [g[1] for g in got] == [1.0, 3.0, None, 5.0, 7.0]
    assert [round(g[2] / z, 9) for g in got] == [2, 3, 3, 4, 3]
    chunked = [tuple(r) for r in vectors.association_band(scores, chunk=2).orderBy("centre").collect()]
    assert [c[:2] for c in chunked] == [(1900.5, 2.0), (1902.5, 5.0), (1904.0, 7.0)] and chunked[2][2] is None
    assert {r["half_width"] for r in vectors.association_band(scores.where("year = 1904")).collect()} == {0.0}


