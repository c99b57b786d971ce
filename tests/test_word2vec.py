"""Training by stratified blocks."""

import gc
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexispark.operators import training, vectors, word2vec
from lexispark.schema import CORPUS
from lexispark.sources.shared import Steps

ROWS = [(f"{a} {b}", y, 50, 5) for y in (1990, 2000) for a in ("cat", "dog") for b in ("purrs", "runs", "eats")] + [(f"{a} {b}", 2000, 50, 5) for a in ("stone", "rock") for b in ("lies", "falls", "breaks")]


@pytest.fixture(scope="module")
def pairs(spark):
    return training.cooccurrences(spark.createDataFrame(ROWS, CORPUS), 2, "freq").persist()


@pytest.mark.parametrize("blocks, approach", [(1, "skip-gram"), (4, "skip-gram"), (4, "CBOW")])
def test_like_words_come_together(spark, pairs, blocks, approach):
    often = pairs.where("year = 2000").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(80)))).drop("copy")
    out = word2vec.train(often, vector_size=8, approach=approach, epochs=3, rate=0.15, blocks=blocks)
    sims = {(r["word1"], r["word2"]): r["similarity"] for r in vectors.word_cosine(out, spark.createDataFrame([("cat", "dog"), ("cat", "stone")], "word1 string, word2 string")).collect()}
    assert sims["cat", "dog"] > sims["cat", "stone"] + 0.2


def test_same_vectors_every_time_and_on_any_layout(spark, pairs):
    run = lambda p: sorted(map(tuple, word2vec.train(p, vector_size=4, epochs=2, blocks=3, seed=5).collect()))
    out = run(pairs)
    assert out == run(pairs.repartition(7)) and len(out) == len({r[:2] for r in out}) == 5 + 10
    assert {r[0] for r in out} == {1990, 2000}
    first = {w: word2vec.first_vector(w, 4, 5) for _, w, _ in out}
    assert sum(not np.array_equal(v, first[w]) for _, w, v in out) > len(out) / 2  # few pairs are drawn, not every word moves


def test_a_round_trains_disjoint_blocks_and_all_rounds_every_pair(spark):
    rows = spark.range(4000).select(F.lit(2000).alias("year"), F.concat(F.lit("w"), F.col("id") % 400).alias("word"), F.concat(F.lit("c"), (F.col("id") * 7) % 390).alias("context"), F.lit(1.0).alias("n"))
    whole = word2vec.block_sizes(rows, 1).collect()
    for blocks in (2, 8):
        sizes = word2vec.block_sizes(rows, blocks).collect()
        assert sum(r["n_pairs"] for r in sizes) == 4000
        assert max(r["n_pairs"] for r in sizes) < 2 * 4000 / blocks**2 and max(r["n_words"] for r in sizes) < 1.6 * whole[0]["n_words"] / blocks
        for turn in range(blocks):
            own = [(r["block"], (r["block"] + turn) % blocks) for r in sizes if r["turn"] == turn]
            assert len({a for a, _ in own}) == len({b for _, b in own}) == len(own)


def test_step_is_the_gradient_of_negative_sampling():
    """One pair, one negative, against the derivative by differences."""
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((1, 3)).astype(np.float32), rng.standard_normal((1, 3)).astype(np.float32)
    before = x.astype(float), y.astype(float)

    def loss(a, b):  # the only context is both the target and the negative
        s = 1 / (1 + np.exp(-(a @ b)))
        return np.log(s) + np.log(1 - s)

    word2vec.descend(x, y, np.array([0]), np.array([0]), np.array([1.0]), np.array([1.0]), 1, 1e-2, rng)
    for now, i in ((x, 0), (y, 1)):
        want = []
        for d in range(3):
            up, down = [b.copy() for b in before], [b.copy() for b in before]
            up[i][0, d] += 1e-5
            down[i][0, d] -= 1e-5
            want.append((loss(up[0][0], up[1][0]) - loss(down[0][0], down[1][0])) / 2e-5)
        assert np.allclose((now - before[i])[0], np.array(want) * 1e-2, atol=1e-5)


def test_no_pairs(spark, pairs):
    assert word2vec.train(pairs.limit(0), vector_size=4, epochs=1, blocks=2).count() == 0


def _shuffle_files(spark):
    return [b for b in (f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles())) if b.startswith("shuffle_")]


def test_a_step_leaves_no_shuffle_files(spark):
    gc.collect()
    before = set(_shuffle_files(spark))
    with Steps(spark, "files") as steps:
        steps.table(spark.range(1000).repartition(3, "id"), "rows")
        for _ in range(50):
            if not set(_shuffle_files(spark)) - before:
                break
            time.sleep(0.2)
        assert not set(_shuffle_files(spark)) - before


def test_pairs_and_windows_of_longer_ngrams(spark):
    rows = [("x y z", 1990, 40, 3), ("y x x", 1990, 2, 3), ("rare x y", 1990, 1, 1), ("x", 1990, 9, 9), ("z y", 2000, 9, 9)]
    pairs, windows, c = {}, {}, {}
    for g, y, _, _ in rows:
        for t in g.split():
            c[y, t] = c.get((y, t), 0) + 1
    for g, y, _, _ in rows:
        t = [w if c[y, w] >= 2 else None for w in g.split()]
        for i, w in enumerate(t):
            near = [t[j] for j in range(max(0, i - 2), min(len(t), i + 3)) if j != i and t[j]]
            for x in near if w else ():
                pairs[y, w, x] = pairs.get((y, w, x), 0) + 1
            if w and near:
                windows[y, w, tuple(near)] = windows.get((y, w, tuple(near)), 0) + 1
    ngrams = spark.createDataFrame(rows, CORPUS)
    out = training.cooccurrences(ngrams, 2, min_count=2)
    assert {(r["year"], r["word"], r["context"]): r["n"] for r in out.collect()} == pairs
    assert {(r["year"], r["word"], tuple(r["context"])): r["n"] for r in training.context_windows(ngrams, 2, min_count=2).collect()} == windows
    assert "Join" not in out._jdf.queryExecution().toString()  # the pairs are a table, however often they are read


@pytest.mark.parametrize("approach", ("skip-gram", "CBOW"))
def test_a_large_year_is_trained_by_blocks(spark, monkeypatch, approach):
    """No group then gets a whole year; years that fit one group stay as they are."""
    monkeypatch.setattr(training, "GROUP", 16)
    taken = []
    monkeypatch.setattr(word2vec, "train", lambda pairs, *args, train=word2vec.train: taken.append((sorted({r[0] for r in pairs.select("year").collect()}), args[-1])) or train(pairs, *args))
    corpus = spark.createDataFrame(ROWS, CORPUS)
    rows = training.cooccurrences(corpus, 1, "freq") if approach == "skip-gram" else training.context_windows(corpus, 1, "freq")
    out = training.train(rows, vector_size=8, approach=approach, epochs=10, rate=0.4)
    sims = {(r["word1"], r["word2"]): r["similarity"] for r in vectors.word_cosine(out.where("year = 2000"), spark.createDataFrame([("cat", "dog"), ("cat", "stone")], "word1 string, word2 string")).collect()}
    assert taken == [([2000], 2)] and sims["cat", "dog"] > sims["cat", "stone"]
    assert sorted(r["year"] for r in out.collect()) == [1990] * 5 + [2000] * 10


def test_a_block_is_written_as_numbers_of_its_words():
    rows = [(2000, 0, 1, "b", "x", 1.0), (2000, 0, 1, "a", "y", 2.0), (2000, 0, 1, "b", "y", 4.0), (2000, 1, 0, "c", "x", 8.0)]
    columns = [pa.array(c) for c in zip(*rows, strict=True)]
    batch = pa.RecordBatch.from_arrays([*(c.cast(pa.int32()) for c in columns[:3]), *columns[3:]], ["year", "block", "turn", "word", "context", "n"])
    out = [r for b in word2vec._code(iter([batch.slice(0, 2), batch.slice(2)])) for r in b.to_pylist()]
    assert [(r["block"], r["turn"], r["at"]) for r in out] == [(0, 1, 0), (0, 1, 1), (1, 0, 0), (1, 0, 1)]
    assert (out[0]["words"], out[0]["contexts"], out[0]["weights"]) == (["a", "b"], ["x", "y"], [1.0, 6.0])
    of = lambda c, kind: np.frombuffer(out[1][c], kind).tolist()
    assert (of("given", np.int32), of("told", np.int32), of("n", np.float64)) == ([0, 1, 1], [1, 0, 1], [2.0, 1.0, 4.0])
