"""Alignment of yearly word vectors to an anchor year by orthogonal Procrustes, from distributed sums.

The rotation that turns a year onto the anchor depends on the year's cross-covariance alone: the sum over shared words of the
outer products of a word's own vector and the anchor's, dim x dim numbers however many words there are. Words are dealt into
slices of a year; tasks sum slices, one sum a slice is shuffled, and only dim x dim matrices are decomposed. A year's
rotation goes to each of its slices as one row ahead of the words, so nothing is broadcast and no group holds a year.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VECTORS = "year int, word string, vec array<float>"
_SUMS = pa.schema([("year", pa.int32()), ("shared", pa.int64()), ("products", pa.binary()), ("gap", pa.float64()), ("lengths", pa.float64())])
SUMS = "year int, shared long, products binary, gap double, lengths double"
REPORT = "year int, shared long, norm_mean double, r_minus_i double, orthogonality double, residual_before double, residual_after double, message string, is_aligned boolean"


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a column as rows of doubles; all must be of one length."""
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (column.null_count or (sizes != sizes[0]).any()):
        raise ValueError("vectors are null or differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), -1)


def rotation(products: np.ndarray) -> np.ndarray:
    """The orthogonal R that minimises |own R - ref|, from the sum of the outer products own x ref."""
    u, _, vt = np.linalg.svd(products)
    return u @ vt


def _paired(vectors: DataFrame, anchor: int, slices: int) -> DataFrame:
    """year, slice, word, vec, ref of the anchor's words, sorted within tasks by year and slice."""
    reference = vectors.where(F.col("year") == anchor).select("word", F.col("vec").alias("ref"))
    rows = vectors.join(reference, "word").select("year", F.pmod(F.xxhash64("word"), F.lit(slices)).cast("int").alias("slice"), "word", "vec", "ref")
    return rows


def _rows(sums: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([s[i] for s in sums], f.type) for i, f in enumerate(_SUMS)], schema=_SUMS)


def _summed(parts: Iterator[tuple]) -> Iterator[tuple]:
    """One row a year of rows (year, shared, products, gap, lengths) that come year by year."""
    now = None
    for part in parts:
        if now is not None and part[0] == now[0]:
            if part[2].shape != now[2].shape:
                raise ValueError(f"vectors of {part[0]} differ in length")
            now = (now[0], *(a + b for a, b in zip(now[1:], part[1:], strict=True)))
            continue
        if now is not None:
            yield now
        now = part
    if now is not None:
        yield now


def _packed(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    for year, shared, products, *rest in rows:
        yield _rows([(year, shared, products.tobytes(), *rest)])


def covariances(vectors: DataFrame, anchor: int, slices: int = 32) -> DataFrame:
    """Per year: shared words, the sum of outer products with the anchor's vectors (dim x dim little-endian doubles), and sums of squared distances to them and of lengths.

    A year without a word of the anchor's has no row.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple]:
            for batch in batches:
                years, own, ref = batch.column(0).to_numpy(), matrix(batch.column(1)), matrix(batch.column(2))
                if own.shape != ref.shape:
                    raise ValueError("vectors of the anchor and of another year differ in length")
                edges = np.flatnonzero(np.diff(years)) + 1
                for lo, hi in zip([0, *edges], [*edges, len(years)], strict=True):
                    a, b = own[lo:hi], ref[lo:hi]
                    if hi > lo:
                        yield int(years[lo]), hi - lo, a.T @ b, float(((a - b) ** 2).sum()), float(np.linalg.norm(a, axis=1).sum())

        yield from _packed(_summed(parts()))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple]:
            for batch in batches:
                for year, shared, products, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    flat = np.frombuffer(products, np.float64)
                    yield year, shared, flat.reshape(int(len(flat) ** 0.5), -1), *rest

        yield from _packed(_summed(parts()))

    dealt = _paired(vectors, anchor, slices).repartition("year", "slice").sortWithinPartitions("year", "slice").select("year", "vec", "ref")
    return dealt.mapInArrow(partial, SUMS).repartition("year").sortWithinPartitions("year").mapInArrow(total, SUMS)


def covariance_cells(sums: DataFrame) -> DataFrame:
    """(year, i, j, value) of the matrices of ``covariances``, from 0."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for year, products in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                flat = np.frombuffer(products, np.float64)
                dim = int(len(flat) ** 0.5)
                at = np.arange(len(flat), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), year, np.int32)), pa.array(at // dim), pa.array(at % dim), pa.array(flat)], ["year", "i", "j", "value"])

    return sums.select("year", "products").mapInArrow(cells, "year int, i int, j int, value double")


def rotations(sums: DataFrame, anchor: int) -> DataFrame:
    """(year, rotation) as little-endian doubles, row by row; the anchor's own is the identity."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for year, products in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                flat = np.frombuffer(products, np.float64)
                m = flat.reshape(int(len(flat) ** 0.5), -1)
                r = np.eye(len(m)) if year == anchor else rotation(m)
                yield pa.RecordBatch.from_arrays([pa.array([year], pa.int32()), pa.array([r.tobytes()], pa.binary())], ["year", "rotation"])

    return sums.select("year", "products").mapInArrow(turn, "year int, rotation binary")


def align(vectors: DataFrame, anchor: int, slices: int = 32) -> DataFrame:
    """Vectors of every year, cut to the anchor's words and rotated onto its vectors."""
    turns = rotations(covariances(vectors, anchor, slices), anchor)
    ahead = turns.select("year", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(None).cast("string").alias("word"), F.lit(None).cast("array<float>").alias("vec"), "rotation")
    rows = _paired(vectors, anchor, slices).select("year", "slice", "word", "vec", F.lit(None).cast("binary").alias("rotation"))
    dealt = ahead.union(rows).repartition("year", "slice").sortWithinPartitions("year", "slice", F.col("rotation").isNull())

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, r = None, None
        for batch in batches:
            years, held = batch.column(0).to_numpy(), batch.column(4)
            at = np.flatnonzero(held.is_valid().to_numpy(zero_copy_only=False))
            lo = 0
            for hi in [*at.tolist(), len(years)]:
                if hi > lo:
                    if own != years[lo]:
                        raise ValueError(f"no rotation for {years[lo]}")
                    part = batch.slice(lo, hi - lo)
                    out = (matrix(part.column(3)) @ r).astype(np.float32)
                    offsets = np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.ListArray.from_arrays(offsets, out.reshape(-1))], ["year", "word", "vec"])
                if hi < len(years):
                    flat = np.frombuffer(held[hi].as_py(), np.float64)
                    own, r = years[hi], flat.reshape(int(len(flat) ** 0.5), -1)
                lo = hi + 1

    return dealt.mapInArrow(turn, VECTORS)


def report(vectors: DataFrame, anchor: int, tolerance: float = 1e-3, slices: int = 32) -> DataFrame:
    """Per year: shared words, mean length, |R - I|, how far R is from orthogonal, what is left before and after turning, a message, whether it is aligned, and whether its words are the anchor's.

    Lengths and residuals come from the sums: |own R - ref|^2 = |own - ref|^2 - 2 tr((R - I)' M).
    """

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for year, shared, products, far, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                flat = np.frombuffer(products, np.float64)
                m = flat.reshape(int(len(flat) ** 0.5), -1)
                r = rotation(m)
                gap = r - np.eye(len(r))
                f = float(np.linalg.norm(gap))
                said = "aligned" if f < 1e-4 else "nearly aligned" if f < 1e-2 else "not aligned"
                before, after = far**0.5, max(0.0, far - 2 * max(0.0, float((gap * m).sum()))) ** 0.5  # the best rotation is no worse than none
                row = (year, shared, lengths / shared, f, float(np.abs(r.T @ r - np.eye(len(r))).max()), before, after, said, bool(np.abs(gap).max() < tolerance))
                yield pa.RecordBatch.from_pylist([dict(zip((x.split()[0] for x in REPORT.split(", ")), row, strict=True))], schema=_REPORT)

    out = covariances(vectors, anchor, slices).mapInArrow(figures, REPORT)
    words = vectors.groupBy("year").agg(F.count("*").alias("n_words"))
    of_anchor = words.where(F.col("year") == anchor).select(F.col("n_words").alias("n_anchor"))
    matched = words.join(F.broadcast(of_anchor), F.lit(True)).select("year", "n_words", "n_anchor")  # one row
    return out.join(matched, "year").withColumn("vocab_match", (F.col("shared") == F.col("n_words")) & (F.col("shared") == F.col("n_anchor"))).drop("n_words", "n_anchor")


_KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
_REPORT = pa.schema([(name, _KINDS[kind]) for name, kind in (x.split() for x in REPORT.split(", "))])
