"""Quality of a text by a vote of its nearest labelled texts in a latent semantic space.

A text's terms are hashed trigrams of character kinds (letter, capital, digit, each punctuation mark,
white space), hashed common word forms, and a few terms for the shape of the text (how far words
repeat, lines repeat, capitals, length). The TF-IDF vectors of labelled rows give a truncated
singular value decomposition; its right vectors turn every text into a short vector of length 1. The
labelled vectors are broadcast (their number is bounded by ``sample``), the cosines of every document
with all of them are exact products made in blocks, and the ``neighbours`` largest vote with the
weight cosine**power.

The fit uses at most ``sample`` labelled doc_ids per label value, those with the smallest hash, and of
rows that repeat a doc_id the one whose text has the smallest hash. Labels, lang, source and doc_id are
no inputs of a score.

Defined results: null and empty texts get a score like any text (that of the empty term vector's
neighbours). With no labelled rows the score is 0.5. Rows with contradicting labels are not learned
from. All neighbours as near as the last that votes (within ``TIE``) vote too, so the order of labelled
rows doesn't matter, and repeated rows get equal scores but for rounding (scores have 6 decimals). Other
columns are ignored or carried.
"""

from __future__ import annotations

from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import small_batches

KINDS, WORDS, SHAPES = 2048, 1024, 96
DIMS = KINDS + WORDS + SHAPES
TIE = 1e-6  # cosines this close are equal


def _kinds() -> np.ndarray:
    table = np.full(0x250, 3, np.int64)
    for c in range(0x250):
        x = chr(c)
        if x.isalpha():
            table[c] = 2 if x.isupper() else 1
        elif x.isdigit():
            table[c] = 4
        elif x == "\n":
            table[c] = 5
        elif x.isspace():
            table[c] = 0
        elif c < 128:
            table[c] = 6 + c % 58
    return table


_KIND = _kinds()


def terms(text: str) -> np.ndarray:
    """The raw term vector of a text."""
    out = np.zeros(DIMS, np.float32)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    k = _KIND[np.minimum(c, 0x24F)]
    if len(k) >= 3:
        t = (k[:-2] * 64 + k[1:-1]) * 64 + k[2:]
        out[:KINDS] = np.sqrt(np.bincount((t * 2654435761 >> 7) % KINDS, minlength=KINDS))
        out[:KINDS] /= np.linalg.norm(out[:KINDS])
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    if n:
        import zlib

        short = [zlib.crc32(w) for w in words if len(w) <= 5]
        if short:
            w = np.sqrt(np.bincount(np.array(short, np.int64) % WORDS, minlength=WORDS))
            out[KINDS : KINDS + WORDS] = 0.5 * w / np.linalg.norm(w)
    lines = text.split("\n")
    upper, punct = float((k == 2).sum()), float((k >= 6).sum())
    shape = (
        len(set(words)) / n if n else 0.0,
        sum(map(eq, words, words[1:])) / n if n else 0.0,
        1 - len(set(lines)) / len(lines),
        upper / max(len(k), 1),
        min(1.0, punct / max(n, 1) / 2),
        min(1.0, np.log1p(n) / 12),
    )
    for i, x in enumerate(shape):
        at = x * 14.0
        low = int(at)
        out[KINDS + WORDS + i * 16 + low] += 0.6 * (1 - (at - low))
        out[KINDS + WORDS + i * 16 + low + 1] += 0.6 * (at - low)
    return out


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.stack([terms(t or "") for t in texts]) if texts else np.zeros((0, DIMS), np.float32)


class Model(NamedTuple):
    project: np.ndarray  # terms -> latent
    vectors: np.ndarray  # labelled, length 1
    labels: np.ndarray
    neighbours: int
    power: float


def fit(rows: DataFrame, labels: DataFrame, sample: int = 1500, rank: int = 48, neighbours: int = 15, power: float = 8.0) -> Model:
    """From doc_id and text of ``rows`` and doc_id and quality of ``labels``."""
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("lo = hi")
    # The sample is drawn from distinct ids alone; only its texts are fetched, by a join with at most 2 x sample rows.
    ids = rows.select("doc_id").where("doc_id is not null").distinct().join(marks.select("doc_id", F.col("lo").alias("q")), "doc_id").withColumn("place", F.xxhash64("doc_id"))
    n = {r["q"]: r["n"] for r in ids.groupBy("q").agg(F.count("*").alias("n")).collect()}
    near = F.lit(False)
    for q, m in n.items():
        near = near | ((F.col("q") == q) & (F.pmod("place", F.lit(1 << 30)) * F.lit(float(m)) <= float(1 << 30) * (2 * sample + 50)))
    drawn = ids.where(near).withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.pmod("place", F.lit(1 << 30)), "doc_id"))).where(F.col("r") <= sample)

    @F.arrow_udf(T.BinaryType())
    def vector(text: pa.Array) -> pa.Array:
        """Dimensions (u16) and values (f4) that aren't 0, as bytes: the sample stays small on the driver."""
        rows = [terms(t or "") for t in text.to_pylist()]
        return pa.array([at.astype("<u2").tobytes() + v[at].astype("<f4").tobytes() for v in rows for at in [np.flatnonzero(v)]], pa.binary())

    got = rows.select("doc_id", "text").join(F.broadcast(drawn.select("doc_id", "q")), "doc_id").groupBy("doc_id", "q").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))
    with small_batches(rows.sparkSession):
        got = got.select("doc_id", "q", vector("x.text").alias("v")).toArrow().sort_by("doc_id")  # at most 2 x sample rows
    if not len(got):
        return Model(np.zeros((DIMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), neighbours, power)
    a = np.zeros((len(got), DIMS), np.float32)
    for i, x in enumerate(got["v"].to_pylist()):
        a[i, np.frombuffer(x, "<u2", len(x) // 6)] = np.frombuffer(x, "<f4", len(x) // 6, len(x) // 6 * 2)
    idf = (np.log((1 + len(a)) / (1 + (a > 0).sum(axis=0))) + 0.3).astype(np.float32)
    a *= idf
    # Randomised range finder with power steps; the seed is fixed.
    q = a @ np.random.default_rng(7).standard_normal((DIMS, min(rank + 16, len(a)))).astype(np.float32)
    for _ in range(3):
        q = np.linalg.qr(a @ (a.T @ np.linalg.qr(q)[0]))[0]
    _, _, right = np.linalg.svd(q.T @ a, full_matrices=False)
    project = (right[:rank].T * idf[:, None]).astype(np.float32)
    vectors = a @ right[:rank].T
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return Model(project, vectors, got["q"].to_numpy().astype(np.float64), neighbours, power)


def votes(latent: np.ndarray, model: Model) -> np.ndarray:
    """Scores of a block of latent vectors, from the exact cosines with all labelled ones."""
    if not len(model.vectors):
        return np.full(len(latent), 0.5)
    latent = latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    sims = latent @ model.vectors.T
    k = min(model.neighbours, sims.shape[1])
    row, at = np.nonzero(sims >= np.partition(sims, -k, axis=1)[:, -k][:, None] - TIE)
    weight = np.maximum(sims[row, at], 1e-6).astype(np.float64) ** model.power
    good = np.bincount(row, weight * model.labels[at], len(latent))
    return np.round(np.clip(good / np.bincount(row, weight, len(latent)), 0.0, 1.0), 6)


def scorer(spark, model: Model, block: int = 256):
    """Column -> Column: the score of a text column."""
    held = spark.sparkContext.broadcast(tuple(model))

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        own = Model(*held.value)
        out = []
        for i in range(0, len(text), block):
            m = matrix(text.slice(i, block).to_pylist())
            out.append(votes(m @ own.project, own))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return score


def classify(documents: DataFrame, training: DataFrame, labels: DataFrame, cutoff: float = 0.3, **parameters) -> DataFrame:
    """doc_id, score, predicted of every row of ``documents``."""
    score = scorer(documents.sparkSession, fit(training, labels, **parameters))
    return documents.select("doc_id", score("text").alias("score")).withColumn("predicted", (F.col("score") >= cutoff).cast("int"))


def filter_documents(documents: DataFrame, training: DataFrame, labels: DataFrame, cutoff: float = 0.3, **parameters) -> DataFrame:
    """The rows of ``documents`` that are predicted 1, with their columns."""
    score = scorer(documents.sparkSession, fit(training, labels, **parameters))
    return documents.select(F.struct("*").alias("_row"), score("text").alias("_s")).where(F.col("_s") >= cutoff).select("_row.*")
