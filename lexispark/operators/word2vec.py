"""Skip-gram word2vec of years that are larger than a task, by stratified blocks.

Words are dealt into B blocks by hash, as the predicting and as the predicted side, so a year's pairs fall into B x B blocks. In
a round, B blocks that share neither words nor contexts are trained at once, each in a task of its own: block i of the words with
block (i + r) mod B of the contexts. B rounds see every pair. Between rounds the vectors are a table of words in the shared folder, from which each task gets the
two shards it needs. A task holds two shards (1/B of the year's vectors each) and one block of pairs (about 1/B^2 of them, 16 bytes a pair); so a
larger year takes more blocks, not more memory. ``block_sizes`` tells how large they are. Pairs are shuffled as text once: a block is written as numbers
of its own words, and a round moves these and the vectors.

Negative samples come from the contexts of the same block, in proportion to their count to the power 0.75. Everything follows
from ``seed``: first vectors from the word's hash, draws from year, block and round.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Steps

VECTORS = "year int, word string, vec array<float>"
STATE = "year int, side int, block int, word string, weight double, vec array<float>"
_STATE = pa.schema([("year", pa.int32()), ("side", pa.int32()), ("block", pa.int32()), ("word", pa.string()), ("weight", pa.float64()), ("vec", pa.list_(pa.float32()))])
_WORD, _CONTEXT, _PAIR = 0, 1, 2

#: A block: a row of its words and contexts in order (and how often these are told), then rows of up to ``CHUNK`` pairs as places in them.
CODED = "year int, block int, turn int, at int, words array<string>, contexts array<string>, weights array<double>, given binary, told binary, n binary"
_CODED = pa.schema([*((c, pa.int32()) for c in ("year", "block", "turn", "at")), ("words", pa.list_(pa.string())), ("contexts", pa.list_(pa.string())), ("weights", pa.list_(pa.float64())), *((c, pa.binary()) for c in ("given", "told", "n"))])
CHUNK = 1 << 16


def _block(column: str, blocks: int):
    return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")


def _dealt(pairs: DataFrame, blocks: int) -> DataFrame:
    """year, word, context, n, the pair's block of words, and the round that trains it."""
    own = pairs.select("year", "word", "context", F.col("n").cast("double").alias("n"), _block("word", blocks).alias("block"), _block("context", blocks).alias("other"))
    return own.select("year", "word", "context", "n", "block", F.pmod(F.col("other") - F.col("block"), F.lit(blocks)).cast("int").alias("turn"))


def block_sizes(pairs: DataFrame, blocks: int) -> DataFrame:
    """(year, block, turn, n_pairs, n_words, n_contexts) of every block that ``train`` works on at once."""
    each = _dealt(pairs, blocks).groupBy("year", "block", "turn")
    return each.agg(F.count("*").alias("n_pairs"), F.countDistinct("word").alias("n_words"), F.countDistinct("context").alias("n_contexts"))


def first_vector(word: str, size: int, seed: int) -> np.ndarray:
    return ((np.random.default_rng([seed, zlib.crc32(word.encode())]).random(size) - 0.5) / size).astype(np.float32)


def add_rows(m: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """``np.add.at(m, at, rows)`` of the rows of a matrix, number by number, which numpy adds some four times as fast."""
    np.add.at(m.reshape(-1), (at.reshape(-1, 1).astype(np.int64) * m.shape[1] + np.arange(m.shape[1])).ravel(), rows.ravel())


def descend(x: np.ndarray, y: np.ndarray, given: np.ndarray, told: np.ndarray, n: np.ndarray, weight: np.ndarray, negative: int, rate: float, rng: np.random.Generator) -> None:
    """One pass over a block: as many pairs as it has, drawn in proportion to n; x and y change in place.

    Steps of a batch are summed, so a batch has no more pairs than there are words: few words would be moved too far.
    """
    batch = int(np.clip(min(len(x), len(y)), 8, 512))
    drawn, noise = np.cumsum(n) / n.sum(), np.cumsum(weight**0.75)
    noise /= noise[-1]
    rows = np.searchsorted(drawn, rng.random(len(n))).clip(0, len(n) - 1)
    for i in range(0, len(rows), batch):
        k = rows[i : i + batch]
        targets = np.concatenate([told[k][:, None], np.searchsorted(noise, rng.random((len(k), negative))).clip(0, len(weight) - 1)], axis=1)
        label = np.zeros(targets.shape, np.float32)
        label[:, 0] = 1
        hidden, seen = x[given[k]], y[targets]
        err = ((label - 1 / (1 + np.exp(-(seen @ hidden[:, :, None])[:, :, 0].clip(-30, 30)))) * rate).astype(np.float32)
        back = (err[:, None, :] @ seen)[:, 0]
        add_rows(y, targets, err[:, :, None] * hidden[:, None, :])
        add_rows(x, given[k], back)


def _ordered(texts: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
    """The different texts of dictionary arrays in order, and the place of each text among them."""
    coded = pa.chunked_array(texts).unify_dictionaries()
    words = coded.chunk(0).dictionary
    order = pc.sort_indices(words)
    place = np.empty(len(words), np.int32)
    place[order.to_numpy()] = np.arange(len(words))
    return words.take(order), place[np.concatenate([c.indices.to_numpy() for c in coded.chunks])]


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``CODED`` rows of pairs (year, block, turn, word, context, n) in order of block; their text is held only as long as a batch."""
    now, held = None, []

    def done() -> Iterator[pa.RecordBatch]:
        word, context, n = zip(*held, strict=True)
        (words, given), (contexts, told), n = _ordered(word), _ordered(context), np.concatenate(n)
        order = np.lexsort((n, told, given))
        given, told, n = given[order], told[order], n[order]
        own, none = [pa.array([x], pa.int32()) for x in now], [pa.nulls(1, t) for t in _CODED.types[4:]]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (words, contexts, pa.array(np.bincount(told, n, len(contexts))))]
        yield pa.RecordBatch.from_arrays([*own, pa.array([0], pa.int32()), *lists, *none[3:]], schema=_CODED)
        for i in range(0, len(n), CHUNK):
            parts = [pa.array([x[i : i + CHUNK].tobytes()], pa.binary()) for x in (given, told, n)]
            yield pa.RecordBatch.from_arrays([*own, pa.array([i // CHUNK + 1], pa.int32()), *none[:3], *parts], schema=_CODED)

    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
        edges = np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            if hi == lo:
                continue
            if now != (key := tuple(keys[:, lo].tolist())):
                if held:
                    yield from done()
                now, held = key, []
            part = batch.slice(lo, hi - lo)
            held.append((part.column(3).dictionary_encode(), part.column(4).dictionary_encode(), part.column(5).to_numpy()))
    if held:
        yield from done()


class _Shards:
    """What a task has gathered of one group: two shards of vectors and a block of pairs."""

    def __init__(self, size: int, seed: int):
        self.size, self.seed = size, seed
        self.rows: tuple[list, list] = ([], [])
        self.vecs: tuple[list, list] = ([], [])
        self.pairs: list[tuple[np.ndarray, ...]] = []

    def add(self, side: int, rows: pa.RecordBatch) -> None:
        if side == _PAIR:
            for i in range(rows.num_rows):
                if rows.column("given")[i].is_valid:
                    given, told, n = (np.frombuffer(rows.column(c)[i].as_buffer(), t) for c, t in (("given", np.int32), ("told", np.int32), ("n", np.float64)))
                    self.pairs.append((self.place[_WORD][given], self.place[_CONTEXT][told], n))
                else:  # the block's own words among those of the shards
                    self.place = [pc.index_in(rows.column(c)[i].values, value_set=pa.concat_arrays([w for w, _, _ in self.rows[k]])).to_numpy() for k, c in ((_WORD, "words"), (_CONTEXT, "contexts"))]
            return
        words, vecs = rows.column("word"), rows.column("vec")
        held = vecs.is_valid().to_numpy(zero_copy_only=False)
        out = np.zeros((len(words), self.size), np.float32)
        out[held] = vecs.flatten().to_numpy(zero_copy_only=False).reshape(-1, self.size)
        if side == _WORD:
            for i in np.flatnonzero(~held):
                out[i] = first_vector(words[i].as_py(), self.size, self.seed)
        self.vecs[side].append(out)
        self.rows[side].append((words, rows.column("weight"), rows.column("block")))

    def trained(self, year: int, negative: int, rate: float, rng: np.random.Generator) -> Iterator[pa.RecordBatch]:
        x, y = (np.concatenate(v) if v else np.zeros((0, self.size), np.float32) for v in self.vecs)
        if self.pairs:
            given, told, n = map(np.concatenate, zip(*self.pairs, strict=True))
            self.pairs.clear()
            weight = np.concatenate([w.to_numpy() for _, w, _ in self.rows[_CONTEXT]])
            descend(x, y, given, told, n, weight, negative, rate, rng)
        for side, m in ((_WORD, x), (_CONTEXT, y)):
            at = 0
            for words, weights, blocks in self.rows[side]:
                part = m[at : at + len(words)]
                at += len(words)
                offsets = np.arange(0, part.size + 1, self.size, dtype=np.int32)
                columns = [pa.array(np.full(len(words), year, np.int32)), pa.array(np.full(len(words), side, np.int32)), blocks, words, weights, pa.ListArray.from_arrays(offsets, pa.array(part.reshape(-1)))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _STATE, strict=True)], schema=_STATE)


def _round(state: DataFrame, coded: DataFrame, years: list[int], blocks: int, turn: int, epoch: int, size: int, negative: int, rate: float, seed: int) -> DataFrame:
    none = lambda *columns: [F.lit(None).cast(coded.schema[c].dataType if c in coded.columns else state.schema[c].dataType).alias(c) for c in columns]
    group = F.when(F.col("side") == _WORD, F.col("block")).otherwise(F.pmod(F.col("block") - turn, F.lit(blocks)))
    shards = state.select("year", group.cast("int").alias("group"), "side", F.lit(0).alias("at"), "block", "word", "weight", "vec", *none("words", "contexts", "given", "told", "n"))
    own = coded.where(F.col("turn") == turn).select("year", F.col("block").alias("group"), F.lit(_PAIR).alias("side"), "at", *none("block", "word", "weight", "vec"), "words", "contexts", "given", "told", "n")
    # A group is a task of its own, however few bytes it has.
    task = (F.array_position(F.array(*map(F.lit, years)), F.col("year")).cast("int") - 1) * blocks + F.col("group")
    dealt = shards.union(own).repartitionById(len(years) * blocks, task).sortWithinPartitions("year", "group", "side", "at", "word")

    def train_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None

        def done() -> Iterator[pa.RecordBatch]:
            rng = np.random.default_rng([seed, now[0], now[1], turn, epoch])
            yield from held.trained(now[0], negative, rate, rng)

        for batch in batches:
            year, group, side = (batch.column(i).to_numpy() for i in range(3))
            edges = np.flatnonzero((np.diff(year) != 0) | (np.diff(group) != 0) | (np.diff(side) != 0)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(year)], strict=True):
                if hi == lo:
                    continue
                if now != (year[lo], group[lo]):
                    if held:
                        yield from done()
                    now, held = (int(year[lo]), int(group[lo])), _Shards(size, seed)
                held.add(int(side[lo]), batch.slice(lo, hi - lo))
        if held:
            yield from done()

    return dealt.mapInArrow(train_group, STATE)


def train(pairs: DataFrame, vector_size: int = 100, approach: str = "skip-gram", epochs: int = 5, negative: int = 5, seed: int = 1, rate: float = 0.05, blocks: int = 1) -> DataFrame:
    """(year, word, vec) from pairs (year, word, context, n), as ``training.cooccurrences`` makes them.

    'skip-gram' predicts the context from the word, anything else the word from one context word (CBOW of windows of one). Words that are only
    predicted keep their first vector. Rounds are epochs times ``blocks``; each reads and writes the vectors once. A pair that repeats counts as often.
    """
    if approach != "skip-gram":
        pairs = pairs.select("year", F.col("context").alias("word"), F.col("word").alias("context"), "n")
    with Steps(pairs.sparkSession, "word2vec") as steps:
        keys = ("year", "block", "turn")
        dealt = _dealt(pairs, blocks).select(*keys, "word", "context", "n").repartition(*keys).sortWithinPartitions(*keys)
        coded = steps.table(dealt.mapInArrow(_code, CODED), "pairs", "turn")
        years = sorted(r["year"] for r in coded.select("year").distinct().collect())
        told = F.explode(F.arrays_zip("contexts", "weights")).alias("s")
        sides = [(_WORD, coded.select("year", F.explode("words").alias("word"), F.lit(0.0).alias("n"))), *((side, coded.select("year", told).select("year", F.col("s.contexts").alias("word"), n.alias("n"))) for side, n in ((_WORD, F.lit(0.0)), (_CONTEXT, F.col("s.weights"))))]
        each = functools.reduce(DataFrame.union, (x.select("year", F.lit(side).alias("side"), "word", "n") for side, x in sides)).groupBy("year", "side", "word").agg(F.sum("n").alias("weight"))
        state = steps.table(each.select("year", "side", _block("word", blocks).alias("block"), "word", "weight", F.lit(None).cast("array<float>").alias("vec")), "state_0")
        for i in range(epochs * blocks if years else 0):
            epoch, turn = divmod(i, blocks)
            state = steps.table(_round(state, coded, years, blocks, turn, epoch, vector_size, negative, rate * (1 - epoch / epochs), seed), f"state_{i + 1}")
            steps.drop(f"state_{i}")
        return steps.keep(state.where(F.col("side") == _WORD).select("year", "word", "vec"))
