"""Brown's class-based bigram model: exchange clustering, training counts and scores of whole texts.

log10 P(text) = sum over its tokens of log10 P(class | class before) + log10 P(token | class). Tokens
are the words in lower case (A-Z), then one end; the end is also what stands before the first word.

Every training word has a class of its own choosing, found by the exchange algorithm in two parts. The
``units`` most frequent words are exchanged in rounds, while every other word stands with the words that
share its last three bytes (the ``forms`` most frequent endings, and one form for the rest): one Spark job
sums, per unit, how often each class stands right and left of it (units x classes numbers, the only
thing that reaches the driver); then half of the units move to the class that raises the likelihood of
the class bigrams most. Rounds alternate between halves, and the best assignment seen is kept. Then every
word beyond the units is exchanged: its neighbours' classes are summed into a table by word, at most
2 x classes + 1 numbers each, and the word moves from the class of its form to the one of the highest
gain. These sums grow with the vocabulary and stay in Spark; tasks get the class bigrams only. A word
without training counts has the class of its form.

Class bigrams, class sizes and emissions are counted anew from the final classes of all words.

Smoothing: P(b | a) = (n(a, b) + mu P(b)) / (n(a) + mu); P(w | c) = (n(w) + 0.1) / (n(c) + 0.1 (v(c) + 1)),
with v(c) the distinct words of the class, and one more for all that are unknown. The base is the
same additive estimate without classes.

Counts and classes of frequent words (``head``) are broadcast for scoring; other words of a text are
joined with the table of all words, once a document and word, so no token is scored from a truncated
vocabulary.

Defined results: a null or empty text has one token, the end. Rows with null doc_id are held out or
not as the caller's column says. Without training rows every log-probability of a token is finite
(0 where there is but one outcome). Repeated rows are scored, and counted, each. Other columns are
ignored. Ties: of equally frequent words or endings the smaller (by bytes) comes first; a unit moves only
to a class that is better by more than 1e-9, the lowest of equally good ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HashedWords, Scratch, hashes_of, mix

END = b""
END_HASH = np.uint64(0)  # stands for the end where words are counted by hash; the end is no word
SMALL = 16  # counts below it are so frequent that what they add to each class bigram is tabled
ADD = 0.1  # the additive constant of the contract's base, and of emissions
COUNT = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())])
CODE = T.StructType([T.StructField("code", T.LongType()), T.StructField("n", T.LongType())])
NEXT = T.StructType([T.StructField("h", T.LongType()), T.StructField("present", T.IntegerType()), T.StructField("code", T.IntegerType()), T.StructField("n", T.LongType())])


class Settings(NamedTuple):
    units: int = 8192
    forms: int = 1024
    head: int = 1 << 17
    classes: int = 64
    rounds: int = 12
    mu: float = 20.0


def word_counts(docs: DataFrame, most: int = 400_000) -> DataFrame:
    """(word, n) of all tokens; each task counts in a bounded table before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, parts, waiting = HashedWords(), None, [], 0
        for batch in batches:
            h, first, last, sizes = _batch(words, batch.column("text"))
            h, at, n = np.unique(h, return_index=True, return_counts=True)
            parts.append((np.append(h, END_HASH), np.append(n, len(sizes)), pa.concat_arrays([words.words(first[at], last[at]), pa.array([END])])))
            waiting += len(h)
            if waiting > most // 4:
                held, parts, waiting = _summed([held, *parts] if held else parts), [], 0
                if len(held[0]) > most:
                    yield _pairs(held)
                    held = None
        if held or parts:
            yield _pairs(_summed([held, *parts] if held else parts))

    return docs.select("text").mapInArrow(count, COUNT).repartition("word").groupBy("word").agg(F.sum("n").alias("n"))


def _summed(parts: list[tuple[np.ndarray, np.ndarray, pa.Array]]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Hashes, counts and words, each hash once."""
    h, n, words = (np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]), pa.concat_arrays([x[2] for x in parts]))
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], np.add.reduceat(n[order], first), words.take(pa.array(order[first]))


def _pairs(held: tuple[np.ndarray, np.ndarray, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([held[2], pa.array(held[1].astype(np.int64))], ["word", "n"])


def most_frequent(counts: DataFrame, n: int) -> pa.Table:
    """The n most frequent words (ties: the smaller), found behind a histogram of log counts."""
    step = F.floor(F.log2("n") * 4)
    steps = sorted(((r["s"], r["c"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("c")).collect()), reverse=True)
    total, least = 0, 0
    for s, c in steps:  # at most 4 * 63 rows
        total, least = total + c, s
        if total >= n:
            break
    return counts.where(step >= least).orderBy(F.col("n").desc(), "word").limit(n).toArrow()


class _Codes(dict):
    """word -> code; the code of any other word is that of its form, looked up each time."""

    def __init__(self, words: dict[bytes, int], forms: dict[bytes, int], other: int):
        super().__init__(words)
        self.forms, self.other = forms, other

    def __missing__(self, word: bytes) -> int:
        return self.forms.get(word[-3:], self.other)


class _Places:
    """Where 64-bit hashes stand in a table: the first bits name a bucket of one hash or a few."""

    def __init__(self, hashes: np.ndarray):
        self.bits = max(8, (4 * len(hashes)).bit_length())
        self.hashes = np.append(hashes, np.uint64(0))  # one more, so that every bucket can be looked into
        self.starts = np.searchsorted(hashes >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, which are in the table)."""
        bucket = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.starts[bucket], self.starts[bucket + 1]
        found = (self.hashes[at] == h) & (at < end)
        rest = np.flatnonzero(~found & (end - at > 1))
        while len(rest):
            at[rest] += 1
            found[rest] = self.hashes[at[rest]] == h[rest]
            rest = rest[~found[rest] & (at[rest] + 1 < end[rest])]
        return at, found


class _Lookup:
    """``_Codes`` for hashed words: the same codes, many at once."""

    def __init__(self, words: dict[bytes, int], forms: dict[bytes, int], other: int):
        self.words, self.codes = self._table(hashes_of(list(words))[0], words, other)
        self.endings, self.forms = self._table(mix(hashes_of(list(forms))[1].astype(np.uint64)), forms, other)

    @staticmethod
    def _table(h: np.ndarray, codes: dict[bytes, int], other: int) -> tuple[_Places, np.ndarray]:
        order = np.argsort(h)
        return _Places(h[order]), np.append(np.fromiter(codes.values(), np.int64, len(codes))[order], other)

    def __call__(self, own: HashedWords, h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        at, found = self.words(h)
        out = self.codes[at]
        rest = np.flatnonzero(~found)
        if len(rest):
            at, found = self.endings(mix(own.endings(first[rest], last[rest]).astype(np.uint64)))
            out[rest] = self.forms[np.where(found, at, -1)]
        return out


def _batch(own: HashedWords, column: pa.Array) -> tuple[np.ndarray, ...]:
    """Hashes, first and last bytes of all words of a column, and the words of each text."""
    parts = list(own.spans(column))
    return (*map(np.concatenate, zip(*parts, strict=True)), np.array([len(x[0]) for x in parts])) if parts else (np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3)


def _between_ends(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values with a 0 before, between and after texts, their places): one end stands for that of a text and the start of the next."""
    at = np.arange(len(values)) + np.repeat(np.arange(1, len(sizes) + 1), sizes)
    out = np.zeros(len(values) + len(sizes) + 1, np.int64)
    out[at] = values
    return out, at


def pair_counts(docs: DataFrame, units: dict[bytes, int], forms: dict[bytes, int], size: int, buffer: int = 4 << 20) -> DataFrame:
    """(code, n): code = unit * size + next unit, over all neighbours, ends included (unit 0)."""
    held = docs.sparkSession.sparkContext.broadcast((units, forms))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, own, parts, waiting = _Lookup(*held.value, size - 1), HashedWords(), [], 0
        for batch in batches:
            *words, sizes = _batch(own, batch.column("text"))
            u, _ = _between_ends(of(own, *words), sizes)
            parts.append(u[:-1] * size + u[1:])
            waiting += len(u) - 1
            if waiting >= buffer:
                yield _codes(np.concatenate(parts))
                parts, waiting = [], 0
        if parts:
            yield _codes(np.concatenate(parts))

    return docs.select("text").mapInArrow(count, CODE).groupBy("code").agg(F.sum("n").alias("n"))


def _codes(codes: np.ndarray) -> pa.RecordBatch:
    code, n = np.unique(codes, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], ["code", "n"])


def neighbours(pairs: DataFrame, cls: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(right, left): per unit, how often each class follows and precedes it."""
    size = len(cls)
    held = pairs.sparkSession.sparkContext.broadcast(cls)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, c = np.zeros(2 * size * classes), held.value
        for batch in batches:
            code, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            u, v = code // size, code % size
            np.add.at(own, u * classes + c[v], n)  # batches are small beside the sums
            np.add.at(own, (size + v) * classes + c[u], n)
        at = np.flatnonzero(own)
        for i in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + (1 << 16)]), pa.array(own[at[i : i + (1 << 16)]].astype(np.int64))], ["code", "n"])

    got = pairs.mapInArrow(add, CODE).groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    flat = np.zeros(2 * size * classes)
    flat[got["code"].to_numpy()] = got["n"].to_numpy()
    return flat[: size * classes].reshape(size, classes), flat[size * classes :].reshape(size, classes)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(n: np.ndarray) -> float:
    """What the class bigrams add to the log-likelihood; words within classes don't change it."""
    return float(_f(n).sum() - _f(n.sum(axis=0)).sum() - _f(n.sum(axis=1)).sum())


def bigrams(right: np.ndarray, cls: np.ndarray) -> np.ndarray:
    n = np.zeros((right.shape[1], right.shape[1]))
    np.add.at(n, cls, right)
    return n


def exchange(right: np.ndarray, left: np.ndarray, own: np.ndarray, cls: np.ndarray, movers: np.ndarray) -> np.ndarray:
    """The classes after each mover has taken its best class, all seen from the present classes."""
    n, out = bigrams(right, cls), cls.copy()
    rows, cols = n.sum(axis=1), n.sum(axis=0)
    for i in range(0, len(movers), 64):
        u = movers[i : i + 64]
        k, a, r, l, s = np.arange(len(u)), cls[u], right[u], left[u], own[u]  # noqa: E741
        without = np.repeat(n[None], len(u), axis=0)
        without[k, a, :] -= r
        without[k, :, a] -= l
        without[k, a, a] += s
        r, l, tr, tl = r.copy(), l.copy(), r.sum(axis=1), l.sum(axis=1)  # noqa: E741
        r[k, a] -= s
        l[k, a] -= s
        f = _f(without)
        by_row, by_col = _f(without + r[:, None, :]) - f, _f(without + l[:, :, None]) - f
        d = np.einsum("kbb->kb", without)
        gain = by_row.sum(axis=2) + by_col.sum(axis=1) + _f(d + r + l + s[:, None]) - np.einsum("kbb->kb", f) - np.einsum("kbb->kb", by_row) - np.einsum("kbb->kb", by_col)
        for total, t in ((rows, tr), (cols, tl)):
            m = np.repeat(total[None], len(u), axis=0)
            m[k, a] -= t
            gain -= _f(m + t[:, None]) - _f(m)
        gain[:, 0] = -np.inf  # class 0 is the end's alone
        best = gain.argmax(axis=1)
        out[u] = np.where(gain[k, best] > gain[k, a] + 1e-9, best, a)
    return out


def cluster(pairs: DataFrame, size: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, class bigram counts)."""
    cls = np.concatenate([[0], np.arange(size - 1) % (s.classes - 1) + 1]).astype(np.int64)
    twins = pairs.where(F.col("code") % (size + 1) == 0).toArrow()  # a unit after itself: at most one row per unit
    own = np.zeros(size)
    own[twins["code"].to_numpy() // (size + 1)] = twins["n"].to_numpy()
    best = (-np.inf, cls, np.zeros((s.classes, s.classes)))
    for i in range(s.rounds + 1):
        right, left = neighbours(pairs, cls, s.classes)
        n = bigrams(right, cls)
        if (now := likelihood(n)) > best[0]:
            best = (now, cls, n)
        if i < s.rounds:
            half = np.flatnonzero((np.arange(size) * 2654435761 >> 5) % 2 == i % 2)
            cls = exchange(right, left, own, cls, half[half > 0])
    return best[1], best[2]


def profiles(docs: DataFrame, units: dict[bytes, int], forms: dict[bytes, int], cls: np.ndarray, classes: int, buffer: int = 1 << 20) -> DataFrame:
    """(h, present, code, n) of every word beyond the units, by its hash, with its present class.

    ``code`` is the class before the word, ``classes`` + the class after it, or 2 * ``classes`` where the
    word follows itself.
    """
    held = docs.sparkSession.sparkContext.broadcast((units, forms, cls))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, forms, cls = held.value
        of, own, parts, waiting = _Lookup(units, forms, len(cls) - 1), HashedWords(), [], 0
        for batch in batches:
            h, first, last, sizes = _batch(own, batch.column("text"))
            u = of(own, h, first, last)
            c, place = _between_ends(cls[u], sizes)
            at = np.flatnonzero(u > len(units))
            if not len(at):
                continue
            follow = at[at + 1 < len(h)]
            again = follow[(h[follow] == h[follow + 1]) & (place[follow] + 1 == place[follow + 1])]
            whose = np.concatenate([at, at, again])
            parts.append((h[whose].view(np.int64), c[place[whose]], np.concatenate([c[place[at] - 1], classes + c[place[at] + 1], np.full(len(again), 2 * classes)])))
            waiting += len(whose)
            if waiting >= buffer:
                yield _counted(parts)
                parts, waiting = [], 0
        if parts:
            yield _counted(parts)

    # tasks have summed what they saw, so rows meet by word at once
    return docs.select("text").mapInArrow(count, NEXT).repartition("h").groupBy("h", "code").agg(F.min("present").alias("present"), F.sum("n").alias("n"))


def _counted(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    h, present, code = map(np.concatenate, zip(*parts, strict=True))
    order = np.argsort(h.view(np.uint64) + code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # equal ones come together
    h, present, code = h[order], present[order], code[order]
    at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (code[1:] != code[:-1])]))
    n = np.diff(np.append(at, len(h)))
    return pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(present[at].astype(np.int32)), pa.array(code[at].astype(np.int32)), pa.array(n)], NEXT.names)


def place(sizes: np.ndarray, code: np.ndarray, x: np.ndarray, present: np.ndarray, n: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
    """The best class of each word of ``profiles``, as ``exchange`` finds it, from the entries that aren't zero.

    ``sizes``: the entries of each word (one at least); ``code`` and ``x``: theirs; ``n``: the class bigrams; ``more``: ``added(n)``.
    """
    more = added(n) if more is None else more
    k, words = len(n), len(sizes)
    w, own = np.repeat(np.arange(words), sizes), np.arange(words)
    right, left, self_ = np.zeros((words, k)), np.zeros((words, k)), np.zeros(words)
    before, after = code < k, (code >= k) & (code < 2 * k)
    left[w[before], code[before]] = x[before]
    right[w[after], code[after] - k] = x[after]
    self_[w[code == 2 * k]] = x[code == 2 * k]
    # in a class that the word isn't in, only cells of its neighbours' classes change; those of its present class come apart
    c, mine = code % k, present[w]
    some = np.where((code < 2 * k) & (c != mine), x, 0.0).astype(np.int64)
    gain = np.empty((len(x), k))
    small = some < SMALL
    gain[small] = more[some[small], after[small].astype(np.int64), c[small]]
    cells = np.where(after[~small, None], n.T[c[~small]], n[c[~small]])
    gain[~small] = _f(cells + some[~small, None]) - _f(cells)
    gain = np.add.reduceat(gain, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
    d, s = n.diagonal(), self_
    i, j = np.nonzero((right > 0) & (left > 0) | (s > 0)[:, None])  # the diagonal's cell gets both
    r, l, d_ = right[i, j], left[i, j], d[j]  # noqa: E741
    gain[i, j] += _f(d_ + r + l + s[i]) - _f(d_ + r) - _f(d_ + l) + _f(d_)
    for cells, y in ((n.T[present] - left, right[own, present] - s), (n[present] - right, left[own, present] - s)):
        i = np.flatnonzero(y)  # words beside one of their own class
        gain[i] += _f(cells[i] + y[i, None]) - _f(cells[i])
    rows, cols, tr, tl = n.sum(axis=1), n.sum(axis=0), right.sum(axis=1), left.sum(axis=1)
    for total, t in ((rows, tr), (cols, tl)):
        values, which = np.unique(t, return_inverse=True)
        gain -= (_f(total + values[:, None]) - _f(total))[which]
    # and its present class
    cell = np.where(after, n[mine, c], n[c, mine])
    apart = np.where((code < 2 * k) & (c != mine), _f(cell) - _f(cell - x), 0.0)
    d = n[present, present]
    stay = np.add.reduceat(apart, np.concatenate([[0], np.cumsum(sizes)[:-1]])) + _f(d) - _f(d - right[own, present] - left[own, present] + self_)
    stay -= _f(rows[present]) - _f(rows[present] - tr) + _f(cols[present]) - _f(cols[present] - tl)
    gain[own, present] = stay
    gain[:, 0] = -np.inf  # class 0 is the end's alone
    best = gain.argmax(axis=1)
    return np.where(gain[own, best] > stay + 1e-9, best, present)


def added(n: np.ndarray) -> np.ndarray:
    """(x, 0 before and 1 after, class): what x more in each cell of a class's column or row of ``n`` add, for x below ``SMALL``."""
    sides = np.stack([n, n.T])
    return np.stack([_f(sides + x) - _f(sides) for x in range(SMALL)])


def exchange_rest(profile: DataFrame, n: np.ndarray) -> DataFrame:
    """(h, cls) of every word of ``profiles``, each seen from the class bigrams ``n``."""
    held = profile.sparkSession.sparkContext.broadcast(n)

    @F.arrow_udf(T.IntegerType())
    def best(present: pa.Array, entries: pa.Array) -> pa.Array:
        out, more = [], added(held.value)
        for i in range(0, len(present), 256):
            part = entries.slice(i, 256)
            sizes, flat = part.value_lengths().to_numpy(zero_copy_only=False), part.flatten()
            code, x = (y.to_numpy(zero_copy_only=False) for y in flat.flatten())
            out.append(place(sizes, code, x.astype(np.float64), present.slice(i, 256).to_numpy(zero_copy_only=False), held.value, more))
        return pa.array(np.concatenate(out) if out else [], pa.int32())

    words = profile.groupBy("h").agg(F.min("present").alias("present"), F.collect_list(F.struct("code", "n")).alias("entries"))
    return words.select("h", best("present", "entries").alias("cls"))


class Model(NamedTuple):
    head: dict[bytes, int]
    forms: dict[bytes, int]
    log_count: np.ndarray  # log10(n + 0.1) of head words
    cls: np.ndarray  # of head words, then of forms
    emission: np.ndarray  # log10 of each class's denominator
    base: float  # log10 of the base's denominator
    end_count: int
    tokens: int


KNOWN = T.StructType([T.StructField("h", T.LongType()), T.StructField("form_cls", T.IntegerType())])


def fit(train: DataFrame, s: Settings, scratch: Scratch) -> tuple[Model, DataFrame]:
    """The model but for its class bigrams, and the table of all words: word, n, cls."""
    if not 1 < s.classes <= 256:
        raise ValueError("classes must be 2 to 256")
    spark = train.sparkSession
    counts = scratch.table(word_counts(train), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = counts.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = counts.where(F.col("word") != F.lit(END))
    top = most_frequent(words, s.units)
    ending = F.expr("CASE WHEN octet_length(word) <= 3 THEN word ELSE substring(word, octet_length(word) - 2, 3) END")
    by_form = words.groupBy(ending.alias("form")).agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "form").limit(s.forms).toArrow()
    units = {w: 1 + i for i, w in enumerate(top["word"].to_pylist())}
    forms = {f: 1 + len(units) + i for i, f in enumerate(by_form["form"].to_pylist())}
    size = 1 + len(units) + len(forms) + 1
    pairs = scratch.table(pair_counts(train, units, forms, size), "pairs")
    cls, n = cluster(pairs, size, s)
    scratch.drop("pairs")
    placed = exchange_rest(profiles(train, units, forms, cls, s.classes), n)
    held = spark.sparkContext.broadcast((units, forms, cls))

    @F.arrow_udf(KNOWN)
    def known(word: pa.Array) -> pa.Array:
        u, f, c = held.value
        of, all_ = _Codes(u, f, len(c) - 1), word.to_pylist()
        return pa.StructArray.from_arrays([pa.array(hashes_of(all_)[0].view(np.int64)), pa.array([int(c[of[w]]) for w in all_], pa.int32())], KNOWN.names)

    vocabulary = scratch.table(words.select("word", "n", known("word").alias("k")).select("word", "n", "k.*").join(placed, "h", "left").select("word", "n", F.coalesce("cls", "form_cls").alias("cls")), "vocabulary")
    scratch.drop("counts")
    n_c, v_c = np.zeros(s.classes), np.zeros(s.classes)
    n_c[0], v_c[0] = ends, ends > 0
    for r in vocabulary.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        n_c[r["cls"]], v_c[r["cls"]] = r["n"], r["v"]
    top = most_frequent(vocabulary, s.head)
    head = {w: i for i, w in enumerate(top["word"].to_pylist())}
    form_cls = np.array([*(cls[c] for c in forms.values()), cls[size - 1]], np.int64)
    return Model(
        head, {f: len(head) + i for i, f in enumerate(forms)}, np.log10(top["n"].to_numpy().astype(np.float64) + ADD), np.concatenate([top["cls"].to_numpy().astype(np.int64), form_cls]),
        np.log10(n_c + ADD * (v_c + 1)), float(np.log10(total + ADD * (distinct + 1))), int(ends), int(total),
    ), vocabulary


REST = T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("at", T.ArrayType(T.IntegerType()))]))
PART = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("known", T.LongType()), T.StructField("counted", T.DoubleType()), T.StructField("cls", T.BinaryType()), T.StructField("n_rest", T.LongType()), T.StructField("rest", REST)])


def _joined(parts) -> np.ndarray:
    return np.concatenate(parts) if len(parts) else np.empty(0, np.int64)


def _lists(sizes, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def _parts(spark, model: Model):
    """Column -> Column: what the head tells of a text, the classes of its words (of other words, their forms'), and its other words."""
    held, made = spark.sparkContext.broadcast(tuple(model)), []

    @F.arrow_udf(PART)
    def parts(text: pa.Array) -> pa.Array:
        if not made:
            m = Model(*held.value)
            made.extend((m, _Lookup(m.head, m.forms, len(m.head) + len(m.forms)), HashedWords()))
        m, of, own = made
        h, out, words, places, times = len(m.head), [], [], [], []
        end = float(np.log10(m.end_count + ADD))
        *words_, sizes = _batch(own, text)
        cuts = np.cumsum(sizes)[:-1]
        for hashed, first, last, codes in zip(*(np.split(x, cuts) for x in (*words_, of(own, *words_))), strict=True) if len(sizes) else ():
            known, rest = codes[codes < h], np.flatnonzero(codes >= h)
            rest = rest[np.argsort(hashed[rest], kind="stable")]
            new = np.flatnonzero(np.diff(hashed[rest], prepend=~hashed[rest[:1]]))  # each other word once, with its places
            words.append((first[rest[new]], last[rest[new]]))
            places.append(rest)
            times.append(np.diff(np.append(new, len(rest))))
            out.append((len(hashed) + 1, len(known) + (m.end_count > 0), float(m.log_count[known].sum()) + end, m.cls[codes].astype(np.uint8).tobytes(), len(rest)))
        n, k, s, c, r = zip(*out, strict=True) if out else ((),) * 5
        rest = _lists([len(x) for x in times], pa.StructArray.from_arrays([own.words(*map(_joined, zip(*words, strict=True) if words else ((), ()))), _lists(_joined(times), pa.array(_joined(places).astype(np.int32)))], ["word", "at"]))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(s, pa.float64()), pa.array(c, pa.binary()), pa.array(r, pa.int64()), rest], PART.names)

    return parts


@F.arrow_udf(T.BinaryType())
def _with_classes(cls: pa.Array, found: pa.Array) -> pa.Array:
    """The classes of a text's words, those of ``found`` set."""
    cls, hits = cls.cast(pa.large_binary()), found.flatten()
    starts = np.frombuffer(cls.buffers()[1], np.int64, len(cls) + 1, cls.offset * 8)
    own = np.frombuffer(cls.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]].copy()
    starts = starts - starts[0]
    at, of = hits.field("at"), hits.field("cls").to_numpy(zero_copy_only=False)
    times = at.value_lengths().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(found)), found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    own[np.repeat(starts[rows], times) + at.flatten().to_numpy(zero_copy_only=False)] = np.repeat(of, times)
    return pa.Array.from_buffers(pa.large_binary(), len(cls), [None, pa.py_buffer(starts), pa.py_buffer(own)]).cast(pa.binary())


def tagged(docs: DataFrame, model: Model, vocabulary: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, own (sum of log10 of the words' counts) and cls (a byte a word) of every row."""
    parts = scratch.table(docs.select("doc_id", "held_out", _parts(docs.sparkSession, model)("text").alias("p")).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", "p.*"), "parts")
    times = F.size("at")
    found = parts.select("rid", F.explode("rest").alias("x")).select("rid", "x.*").join(vocabulary, "word")
    found = found.groupBy("rid").agg(F.sum(times * F.log10(F.col("n") + F.lit(ADD))).alias("more"), F.sum(times).alias("more_known"), F.collect_list(F.struct("at", "cls")).alias("found"))
    more = F.coalesce("more_known", F.lit(0))
    out = scratch.table(parts.drop("rest").join(found, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + more).alias("n_known"),
        (F.col("counted") + F.coalesce("more", F.lit(0.0)) + (F.col("n_rest") - more) * F.log10(F.lit(ADD))).alias("own"), _with_classes("cls", "found").alias("cls"),
    ), "tagged")
    scratch.drop("parts")
    return out


def _sequence(own: bytes) -> np.ndarray:
    """The classes of a text's words between two ends."""
    c = np.zeros(len(own) + 2, np.int64)
    c[1:-1] = np.frombuffer(own, np.uint8)
    return c


def transitions(train: DataFrame, s: Settings) -> np.ndarray:
    """log10 P(class | class before), smoothed, from the tagged rows that train."""
    k = s.classes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(k * k, np.int64)
        for batch in batches:
            for own in batch.column("cls").to_pylist():
                c = _sequence(own)
                held += np.bincount(c[:-1] * k + c[1:], minlength=k * k)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["code", "n"])

    got = train.select("cls").mapInArrow(count, CODE).groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # classes ** 2 rows at most
    n = np.zeros(k * k)
    n[got["code"].to_numpy()] = got["n"].to_numpy()
    n = n.reshape(k, k)
    prior = (n.sum(axis=0) + 1) / (n.sum() + k)
    return np.log10((n + s.mu * prior[None, :]) / (n.sum(axis=1, keepdims=True) + s.mu))


def _class_score(spark, move: np.ndarray, emission: np.ndarray):
    held = spark.sparkContext.broadcast((move, emission))

    @F.arrow_udf(T.DoubleType())
    def score(cls: pa.Array) -> pa.Array:
        move, emission = held.value
        out = []
        for own in cls.to_pylist():
            c = _sequence(own)
            out.append(float(move[c[:-1], c[1:]].sum() - emission[c[1:]].sum()))
        return pa.array(out, pa.float64())

    return score


def perplexity(scored: DataFrame, score: str = "score") -> DataFrame:
    """held_out, n_tokens and perplexity of all held-out and all other rows together."""
    return scored.groupBy("held_out").agg(F.sum("n_tokens").alias("n_tokens"), F.pow(F.lit(10.0), -F.sum(score) / F.sum("n_tokens")).alias("perplexity"))


def score(documents: DataFrame, held_out: Column, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row; rows that aren't held out train."""
    spark = documents.sparkSession
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out.alias("held_out"))
    with Scratch(spark, "brown") as scratch:
        model, vocabulary = fit(docs.where(~F.col("held_out")), settings, scratch)
        rows = tagged(docs, model, vocabulary, scratch)
        by_class = _class_score(spark, transitions(rows.where(~F.col("held_out")), settings), model.emission)
        return scratch.keep(rows.withColumn("classes", by_class("cls")).select(
            "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
            (F.col("own") - F.col("n_tokens") * F.lit(model.base)).alias("base_score"), (F.col("own") + F.col("classes")).alias("score"),
            F.pow(F.lit(10.0), -(F.col("own") + F.col("classes")) / F.col("n_tokens")).alias("perplexity"),
        ))
