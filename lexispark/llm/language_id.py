"""Language of a text by the nearest of several centroids per language.

A text is a TF-IDF vector of hashed character 2- and 3-grams of its letters (lower case, every other
run one blank), of length 1. Training rows of a language are clustered into up to ``per_language``
centroids by spherical k-means. A text gets the language of the centroid with the largest cosine; a
cosine below that centroid's own low quantile on training rows marks the answer as rejected.

The fit uses at most ``sample`` rows per language, those with the smallest hash of doc_id and text; rows
that repeat both count once. Everything else covers all rows and whole texts. Letters are a-z after lower
case, the Latin-1 letters among U+00AA to U+00BA, and all characters from U+00DF on.

Defined results: a null text or one without a letter is ``und`` with score 0 and rejected. With no
language learned (no row with text and lang) every text is ``und``. A text whose n-grams no training row
has gets the first language, with score 0 and rejected. Ties go to the language that
sorts first. Repeated rows get equal answers; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import small_batches

DIMS = 8192
LATIN = np.array([0xAA, 0xB5, 0xBA], np.uint32)
_A, _B, _C = np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(dimensions, square roots of the counts) of a text."""
    text = text.lower()
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = (c >= 97) & (c <= 122) | (c >= 0xDF) | np.isin(c, LATIN)
    c = np.where(letter, c, np.uint32(32))
    c = np.concatenate([[np.uint32(32)], c[letter | np.concatenate([[True], letter[:-1]])], [np.uint32(32)]]).astype(np.uint32)
    if len(c) < 3:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    two = c[:-1] * _A + c[1:] * _B
    three = two[:-1] * _C + c[2:] * _A
    h = np.concatenate([two, three])
    h ^= h >> np.uint32(15)
    h *= _B
    n = np.bincount((h >> np.uint32(8)) % DIMS, minlength=DIMS)
    at = np.flatnonzero(n)
    return at, np.sqrt(n[at]).astype(np.float32)


def dense(pairs, idf: np.ndarray) -> np.ndarray:
    """Rows of length 1 (or 0 for texts without grams)."""
    m = np.zeros((len(pairs), DIMS), np.float32)
    for i, (at, v) in enumerate(pairs):
        m[i, at] = v
    m *= idf
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def k_means(m: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, started from rows far from one another; no randomness."""
    mean = m.mean(axis=0)
    picked = [int((m @ mean).argmax())]
    while len(picked) < min(k, len(m)):
        picked.append(int((m @ m[picked].T).max(axis=1).argmin()))
    centroids = m[picked]
    for _ in range(rounds):
        nearest = (m @ centroids.T).argmax(axis=1)
        centroids = np.stack([m[nearest == i].sum(axis=0) if (nearest == i).any() else centroids[i] for i in range(len(centroids))])
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    return centroids


class Model(NamedTuple):
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    cutoffs: np.ndarray
    idf: np.ndarray


def fit(rows: DataFrame, sample: int = 400, per_language: int = 3, reject_quantile: float = 0.005) -> Model:
    """From the columns doc_id, text, lang of training rows."""
    rows = rows.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    counts = rows.select("lang", place.alias("place")).distinct().groupBy("lang").agg(F.count("*").cast("double").alias("n"))
    # Rows of a language thin out by hash before any are ranked, so a hot language is never sorted whole.
    some = rows.withColumn("place", place).join(F.broadcast(counts), "lang").where(F.col("place") * F.col("n") <= F.lit(float(1 << 40)) * (2 * sample + 50)).dropDuplicates(["lang", "place"])
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("place"))).where(F.col("r") <= sample)

    @F.arrow_udf(T.BinaryType())
    def sparse(text: pa.Array) -> pa.Array:
        """Dimensions (u16) and values (f4) as bytes; empty without letters."""
        got = [grams(t) if has_letter(t) else (np.empty(0, np.int64), np.empty(0, np.float32)) for t in text.to_pylist()]
        return pa.array([at.astype("<u2").tobytes() + v.astype("<f4").tobytes() for at, v in got], pa.binary())

    with small_batches(rows.sparkSession):
        drawn = some.select("lang", "place", sparse("text").alias("v")).where("octet_length(v) > 0").toArrow().sort_by([("lang", "ascending"), ("place", "ascending")])
    if not len(drawn):
        return Model([], np.zeros((0, DIMS), np.float32), np.zeros(0), np.ones(DIMS, np.float32))
    langs = drawn["lang"].to_pylist()
    vectors = [(np.frombuffer(x, "<u2", len(x) // 6).astype(np.int64), np.frombuffer(x, "<f4", len(x) // 6, len(x) // 6 * 2)) for x in drawn["v"].to_pylist()]
    seen = np.zeros(DIMS, np.int64)
    for at, _ in vectors:
        seen[at] += 1
    idf = np.log((1 + len(vectors)) / (1 + seen)).astype(np.float32) + np.float32(0.1)
    names, centroids, cutoffs = [], [], []
    for lang in sorted(set(langs)):
        m = dense([v for v, of in zip(vectors, langs, strict=True) if of == lang], idf)
        cs = k_means(m, per_language)
        sims = m @ cs.T
        for i, c in enumerate(cs):
            of = sims[sims.argmax(axis=1) == i, i]
            names.append(lang)
            centroids.append(c)
            cutoffs.append(float(np.quantile(of, reject_quantile)) if len(of) else 0.0)
    return Model(names, np.stack(centroids), np.array(cutoffs), idf)


ANSWER = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def predictor(spark, model: Model):
    """Column -> Column: lang_pred, score and rejected of a text column."""
    held = spark.sparkContext.broadcast(tuple(model))

    @F.arrow_udf(ANSWER)
    def predict(text: pa.Array) -> pa.Array:
        names, centroids, cutoffs, idf = held.value
        lang, score, rejected = [], [], []
        weights = centroids * idf
        for t in text.to_pylist():
            if not names or not has_letter(t):
                lang.append("und"), score.append(0.0), rejected.append(True)
                continue
            at, v = grams(t)
            norm = np.linalg.norm(v * idf[at]) if len(at) else 0.0
            sims = weights[:, at] @ v / norm if norm else np.zeros(len(names))
            i = int(sims.argmax())
            lang.append(names[i]), score.append(float(min(1.0, max(0.0, sims[i])))), rejected.append(bool(sims[i] < cutoffs[i]))
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["lang_pred", "score", "rejected"])

    return predict


def identify(documents: DataFrame, training: DataFrame, **parameters) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row of ``documents``."""
    answer = predictor(documents.sparkSession, fit(training, **parameters))
    return documents.select("doc_id", answer("text").alias("a")).select("doc_id", "a.*")
