"""Yearly word vectors (year, word, vec): similarity, drift, relatedness, association tests."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import cosine, dot, norm, unit


def normalise(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("vec", unit(F.col("vec")))


def normalised_report(vectors: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Per year: whether all norms are 1 within the tolerance."""
    return vectors.groupBy("year").agg(F.count("*").alias("n_words"), F.bool_and(F.abs(norm(F.col("vec")) - 1) < tolerance).alias("is_normalized"))


def latest_model(models: DataFrame) -> DataFrame:
    """Of several models (column model) of a year, the one whose name is last."""
    return models.groupBy("year").agg(F.max("model").alias("model"))


def shared(vectors: DataFrame, reference: DataFrame) -> DataFrame:
    """(year, word, vec, ref): vectors of words that the reference has too."""
    return vectors.join(reference.select("word", F.col("vec").alias("ref")), "word")


def filter_vocabulary(vectors: DataFrame, reference: DataFrame) -> DataFrame:
    return vectors.join(reference.select("word").distinct(), "word", "left_semi")


def word_cosine(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """(year, word1, word2, similarity) wherever a year has both words."""
    one = vectors.select("year", F.col("word").alias("word1"), F.col("vec").alias("v1"))
    two = vectors.select("year", F.col("word").alias("word2"), F.col("vec").alias("v2"))
    return pairs.join(one, "word1").join(two, ["year", "word2"]).select("year", "word1", "word2", cosine(F.col("v1"), F.col("v2")).alias("similarity"))


def model_similarity(vectors: DataFrame, reference: DataFrame) -> DataFrame:
    """Per year, mean, population deviation and count of dot products with the reference's vectors."""
    d = shared(vectors, reference).select("year", dot(F.col("vec"), F.col("ref")).alias("d"))
    return d.groupBy("year").agg(F.avg("d").alias("mean"), F.stddev_pop("d").alias("sd"), F.count("*").alias("shared"))


def _previous(vectors: DataFrame) -> DataFrame:
    """(year, previous): the available year before each; years are few."""
    return vectors.select("year").distinct().select("year", F.lag("year").over(Window.orderBy("year")).alias("previous")).where("previous is not null")


def yearly_drift(vectors: DataFrame, word: str | None = None, confidence: float = 0.95, error_type: str = "CI") -> DataFrame:
    """year, drift (1 - mean dot product with the year before that exists), error and shared words.

    error: CI is z * sd / sqrt(n); SE is drift / sqrt(n), as the operators that this follows define it
    (column ``error``); with one shared word it is 0. Years whose mean is exactly 0 are left out.
    """
    if error_type not in ("CI", "SE"):
        raise ValueError(f"error_type must be CI or SE, not {error_type!r}")
    own = vectors if word is None else vectors.where(F.col("word") == word)
    before = own.select(F.col("year").alias("previous"), "word", F.col("vec").alias("ref"))
    d = own.join(_previous(vectors), "year").join(before, ["previous", "word"]).select("year", dot(F.col("vec"), F.col("ref")).alias("d"))
    out = d.groupBy("year").agg(F.avg("d").alias("m"), F.stddev_pop("d").alias("sd"), F.count("*").alias("shared")).where("m <> 0")
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    error = F.lit(z) * F.col("sd") / F.sqrt("shared") if error_type == "CI" else (1 - F.col("m")) / F.sqrt("shared")
    return out.select("year", (1 - F.col("m")).alias("drift"), F.when(F.col("shared") > 1, error).otherwise(0.0).alias("error"), "shared")


def adjusted_drift(drift: DataFrame, regressor: DataFrame, column: str) -> DataFrame:
    """Drift with the residual of its least-squares line on a regressor (year, column)."""
    own = drift.join(regressor.select("year", F.col(column).cast("double").alias("_x")), "year").where("_x is not null")
    line = own.agg(F.regr_slope("drift", "_x").alias("_s"), F.regr_intercept("drift", "_x").alias("_i"))
    return own.crossJoin(F.broadcast(line)).withColumn("drift_adjusted", F.col("drift") - F.col("_s") * F.col("_x") - F.col("_i")).drop("_x", "_s", "_i")  # one row


def relatedness(vectors: DataFrame, word: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Per year, the mean cosine of a word to all others but the excluded; 0 without others.

    The vectors of one word per year are what joins, so a year costs one pass over its words.
    """
    own = vectors.where(F.col("word") == word).select("year", F.col("vec").alias("ref"))
    others = vectors.where((F.col("word") != word) & ~F.col("word").isin(list(excluded))) if excluded else vectors.where(F.col("word") != word)
    sims = own.join(others, "year", "left").select("year", cosine(F.col("ref"), F.col("vec")).alias("c"))
    return sims.groupBy("year").agg(F.coalesce(F.avg("c"), F.lit(0.0)).alias("relatedness"))


def _associations(vectors: DataFrame, targets: tuple[list[str], list[str]], attributes: tuple[list[str], list[str]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(effect of every year, each target's difference of means s, cosines): what association tests are made of; the word lists are arguments, so all of it is small."""
    sets = [(w, i) for i in (0, 1) for w in dict.fromkeys(targets[i])]
    t = vectors.where(F.col("word").isin([w for w, _ in sets])).withColumn("t", F.when(F.col("word").isin(targets[0]), 0).otherwise(1))
    a1 = vectors.where(F.col("word").isin(attributes[0])).select("year", F.col("vec").alias("av"), F.lit(0).alias("a"))
    a2 = vectors.where(F.col("word").isin(attributes[1])).select("year", F.col("vec").alias("av"), F.lit(1).alias("a"))
    sims = t.join(a1.union(a2), "year").select("year", "word", "t", "a", cosine(F.col("vec"), F.col("av")).alias("c"))
    mean = lambda i, j: F.avg(F.when((F.col("t") == i) & (F.col("a") == j), F.col("c")))
    out = sims.groupBy("year").agg((mean(0, 0) - mean(0, 1) - mean(1, 0) + mean(1, 1)).alias("diff"), F.stddev_samp("c").alias("sd"))
    out = out.where("diff is not null").select("year", "diff", F.when(F.col("sd") > 0, F.col("diff") / F.col("sd")).otherwise(F.lit(float("nan"))).alias("effect"), "sd")
    # A target's part in any split is its difference of means; splits only re-sign these.
    each = sims.groupBy("year", "word", "t").agg((F.avg(F.when(F.col("a") == 0, F.col("c"))) - F.avg(F.when(F.col("a") == 1, F.col("c")))).alias("s"))
    return out, each, sims


def _with_p(out: DataFrame, splits: DataFrame) -> DataFrame:
    """Effects with the share of splits (year, pd) that differ at least as much."""
    p = splits.join(out, "year").groupBy("year").agg(F.avg((F.col("pd") >= F.col("diff") - 1e-12).cast("double")).alias("p"))
    return out.join(p, "year", "left").select("year", "effect", "sd", F.when(~F.isnan("effect"), F.col("p")).alias("p"))


def weat(vectors: DataFrame, targets: tuple[list[str], list[str]], attributes: tuple[list[str], list[str]], permutations: int = 0, seed: int = 0) -> DataFrame:
    """Per year: effect, sd (of all pairwise cosines, ddof 1), and p by seeded permutation of targets.

    effect = ((m11 - m12) - (m21 - m22)) / sd with the mean cosines of target set i and attribute set
    j. Missing words are left out. Without variation the effect is NaN and p null; without
    permutations p is null. ``weat_exact`` goes through all splits instead of drawing some.
    """
    out, each, _ = _associations(vectors, targets, attributes)
    if not permutations:
        return out.select("year", "effect", "sd", F.lit(None).cast("double").alias("p"))
    each = each.withColumn("n1", F.sum((F.col("t") == 0).cast("int")).over(Window.partitionBy("year"))).withColumn("n", F.count("*").over(Window.partitionBy("year")))
    shuffled = each.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(permutations)))).withColumn("r", F.row_number().over(Window.partitionBy("year", "k").orderBy(F.xxhash64("word", "k", F.lit(seed)), "word")))
    first = F.col("r") <= F.col("n1")
    return _with_p(out, shuffled.groupBy("year", "k").agg((F.avg(F.when(first, F.col("s"))) - F.avg(F.when(~first, F.col("s")))).alias("pd")))


def weat_exact(vectors: DataFrame, targets: tuple[list[str], list[str]], attributes: tuple[list[str], list[str]], most: int = 18) -> DataFrame:
    """As ``weat``, with p from every split of the year's targets into sets of the same sizes; 2 ** n splits are looked at, so more than ``most`` targets raise."""
    if (n := len(dict.fromkeys([*targets[0], *targets[1]]))) > most:
        raise ValueError(f"{n} targets have too many splits to go through; draw permutations with weat")
    out, each, _ = _associations(vectors, targets, attributes)
    whole = each.groupBy("year").agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "s"))), lambda x: x["s"]).alias("s"), F.count_if(F.col("t") == 0).alias("n1"), F.sum("s").alias("whole"))
    masks = whole.withColumn("mask", F.explode(F.sequence(F.lit(0), F.expr("shiftleft(1, size(s)) - 1")))).where(F.bit_count("mask") == F.col("n1"))
    held = F.aggregate(F.transform("s", lambda x, i: F.when(F.bit_get("mask", i) == 1, x).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    sums = masks.select("year", "n1", F.size("s").alias("n"), "whole", held.alias("held"))
    return _with_p(out, sums.select("year", (F.col("held") / F.col("n1") - (F.col("whole") - F.col("held")) / (F.col("n") - F.col("n1"))).alias("pd")))


def association_band(scores: DataFrame, confidence: float = 0.95, chunk: int = 1) -> DataFrame:
    """(centre, effect, half_width) of association scores (year, effect, sd): half the width of their confidence band.

    The half-width is z times the year's sd; a missing, NaN or zero sd counts as the mean of the others, and as no width if all are. With ``chunk``,
    effects and sds are means over so many neighbouring years; NaN effects don't count. Years are few.
    """
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    known = F.when((F.col("sd") != 0) & ~F.isnan("sd"), F.col("sd"))
    rows = scores.select("year", F.nanvl("effect", F.lit(None).cast("double")).alias("effect"), known.alias("sd"))
    if chunk > 1:
        rows = rows.withColumn("k", F.floor((F.row_number().over(Window.orderBy("year")) - 1) / chunk))
        out = rows.groupBy("k").agg(F.avg("year").alias("centre"), F.avg("effect").alias("effect"), F.avg("sd").alias("sd"))
        return out.select("centre", "effect", (F.lit(z) * F.col("sd")).alias("half_width"))
    every = Window.partitionBy()
    return rows.select(F.col("year").cast("double").alias("centre"), "effect", (F.lit(z) * F.coalesce("sd", F.avg("sd").over(every), F.lit(0.0))).alias("half_width"))


def spearman(pairs: DataFrame, a: str, b: str, by: str) -> DataFrame:
    """Spearman's correlation of two columns in each group: Pearson's of average ranks."""
    def rank(c: str):
        w = Window.partitionBy(by).orderBy(c)
        return F.rank().over(w) + (F.count("*").over(Window.partitionBy(by, c)) - 1) / 2

    return pairs.select(by, rank(a).alias("ra"), rank(b).alias("rb")).groupBy(by).agg(F.corr("ra", "rb").alias("similarity_score"), F.count("*").alias("n_pairs"))


def _goals(vectors: DataFrame, questions: DataFrame) -> DataFrame:
    """year, a, b, c, d and the goal b - a + c of distinct questions whose words a year has."""
    of = lambda n: vectors.select("year", F.col("word").alias(n), F.col("u").alias(f"u{n}"))
    q = questions.select("a", "b", "c", "d").distinct().join(of("a"), "a").join(of("b"), ["year", "b"]).join(of("c"), ["year", "c"]).join(vectors.select("year", F.col("word").alias("d")), ["year", "d"])
    goal = F.zip_with(F.zip_with("ub", "ua", lambda x, y: x.cast("double") - y), "uc", lambda x, y: x + y)
    return q.select("year", "a", "b", "c", "d", goal.alias("g"))


def nearest_to_goals(vectors: DataFrame, questions: DataFrame, slices: int = 16, block: int = 256) -> DataFrame:
    """(year, a, b, c, d, guess): the word nearest to b - a + c, a, b and c aside, among all words of the year; exact.

    A year's words are dealt into slices. Each task gets the year's goals as a matrix and then its words in blocks, and keeps the best of
    every question, so questions x words are never rows: what leaves a task is one row a question. A task holds the goals of one year (dim doubles
    each) and ``block`` rows of products. Cosines count to 9 decimals; of equal ones the last word.
    """
    v = vectors.select("year", "word", unit(F.col("vec")).alias("u"))
    kind = vectors.schema["year"].dataType.simpleString()
    none = lambda t: F.lit(None).cast(t)
    names = [none("string").alias(n) for n in "abcd"]
    ahead = _goals(v, questions).select("year", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), none("string").alias("word"), "a", "b", "c", "d", F.col("g").alias("v"))
    rows = v.select("year", F.pmod(F.xxhash64("word"), F.lit(slices)).cast("int").alias("slice"), "word", *names, F.col("u").cast("array<double>").alias("v"))
    dealt = ahead.union(rows).repartition("year", "slice").sortWithinPartitions("year", "slice", F.col("word").asc_nulls_first(), "a", "b", "c", "d")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, goals, told, best, guess, years_are = None, [], [], None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            at = np.flatnonzero(best > -np.inf) if best is not None else []
            if len(at):
                columns = [[key[0]] * len(at), *([told[i][n] for i in at] for n in range(4)), best[at], [guess[i] for i in at]]
                kinds = (years_are, *(pa.string(),) * 4, pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["year", "a", "b", "c", "d", "s", "guess"])

        for batch in batches:
            years_are = batch.schema.field(0).type
            years, places, words = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            i = 0
            while i < len(years):
                j = i
                while j < len(years) and (years[j], places[j]) == (years[i], places[i]) and (words[j] is None) == (words[i] is None) and j - i < block:
                    j += 1
                if (years[i], places[i]) != key:
                    yield from done()
                    key, goals, told, best, guess = (years[i], places[i]), [], [], None, None
                part = batch.slice(i, j - i)
                m = part.column(7).flatten().to_numpy(zero_copy_only=False).reshape(j - i, -1)
                if words[i] is None:
                    goals.append(m)
                    told += list(zip(*(part.column(n).to_pylist() for n in range(3, 7)), strict=True))
                elif goals:
                    if best is None:
                        goals = [np.concatenate(goals)]
                        best, guess = np.full(len(told), -np.inf), [None] * len(told)
                        own: dict[str, list[int]] = {}
                        for q, (a, b, c, _) in enumerate(told):
                            for w in {a, b, c}:
                                own.setdefault(w, []).append(q)
                    s = np.round(goals[0] @ m.T, 9)
                    for k, w in enumerate(words[i:j]):
                        s[own.get(w, []), k] = -np.inf
                    last = s.shape[1] - 1 - np.argmax(s[:, ::-1], axis=1)  # words come in order: of equal ones the last
                    top = s[np.arange(len(s)), last]
                    for q in np.flatnonzero((top >= best) & (top > -np.inf)):
                        best[q], guess[q] = top[q], words[i + last[q]]
                i = j
        yield from done()

    each = dealt.mapInArrow(search, f"year {kind}, a string, b string, c string, d string, s double, guess string")
    return each.groupBy("year", "a", "b", "c", "d").agg(F.max_by("guess", F.struct("s", "guess")).alias("guess"))


def analogy(vectors: DataFrame, questions: DataFrame, **parameters) -> DataFrame:
    """Per year: share of questions (a, b, c, d) whose d is the word nearest to b - a + c, a, b, c aside; see ``nearest_to_goals``."""
    best = nearest_to_goals(vectors, questions, **parameters)
    return best.groupBy("year").agg(F.avg((F.col("guess") == F.col("d")).cast("double")).alias("analogy_score"), F.count("*").alias("n_questions"))
