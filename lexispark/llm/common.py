"""What the training-data operators share: scratch tables, word splitting, folds."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import CLEANUP

#: Words are runs of anything but these six ASCII characters; ``bytes.split()`` splits at exactly these.
WHITESPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor can reach.

    It is what ``spark.checkpoint.dir`` names. Only in local mode (tests, a laptop) may that be unset: a
    temporary folder is made and set.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_to:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_to = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="lexispark-")
        spark.conf.set("spark.checkpoint.dir", set_to)
    return set_to.rstrip("/")


def filesystem(uri: str):
    """(pyarrow file system, path) of a folder or file, usable in tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


#: Scratch tables are read by what wrote them; on a local disk, a marker costs the driver a process of its own (chmod) for each table.
NO_MARKER = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}

#: Partitions of a shuffle that ``Scratch.narrow`` puts into one file.
GATHER = 16

#: Whole texts are large, and a task holds several copies of a batch: how much Spark reads, and hands to Python, at once.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20, "spark.sql.parquet.columnarReaderBatchSize": 512}


def bound_batches(spark: SparkSession) -> dict[str, str]:
    """Lower the session's batches to ``BATCHES``, for what is computed after this call; what they were.

    Smaller numbers that the session has stay.
    """
    were = {k: spark.conf.get(k) for k in BATCHES}
    for k, most in BATCHES.items():
        if not 0 < _number(were[k]) <= most:
            spark.conf.set(k, most)
    return were


def _number(size: str) -> int:
    """Spark's own reading of a number of rows or bytes."""
    size = size.lower().rstrip("b")
    return int(size[:-1]) << 10 * ("kmgt".index(size[-1]) + 1) if size[-1] in "kmgt" else int(size)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Small Arrow batches while an operator runs; the session's settings are as before afterwards."""
    were = bound_batches(spark)
    try:
        yield
    finally:
        for k, v in were.items():
            spark.conf.set(k, v)


class Scratch:
    """Tables written in the shared folder while an operator runs.

    A written table cuts the lineage and survives the loss of an executor. All but what ``keep``
    wrote goes when the block ends, so an operator leaves only its result behind. The shuffle files of a step go when it ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.made: list[str] = []
        self.batches = small_batches(spark)

    def __enter__(self) -> Scratch:
        self.batches.__enter__()
        self.cleanup = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        return self

    def __exit__(self, *exc) -> None:
        self.spark.conf.set(CLEANUP, self.cleanup)
        self.batches.__exit__(*exc)
        for path in self.made:
            self._delete(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _write(self, df: DataFrame, name: str, compression: str | None = None) -> tuple[str, DataFrame]:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").options(**NO_MARKER).parquet(path, compression=compression)
        return path, self.spark.read.schema(df.schema).parquet(path)

    def table(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        """Write and read again; what is mostly hashes isn't worth compressing."""
        path, out = self._write(df, name, compression)
        self.made.append(path)
        return out

    def narrow(self, df: DataFrame) -> DataFrame:
        """What comes out of a shuffle, to be written: a file for every ``GATHER`` partitions of it, but as many as there are cores.

        Each file and its folders cost processes (chmod) on a local disk, started by the executor; until such a process runs
        its own program, the memory of the executor counts as its own too. So files must not be as many as partitions.
        """
        return df.coalesce(max(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // GATHER))

    def gathered(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        return self.table(self.narrow(df), name, compression)

    def drop(self, name: str) -> None:
        """Give back a table's disk before the block ends."""
        path = f"{self.root}/{name}"
        self.made.remove(path)
        self._delete(path)

    def keep(self, df: DataFrame, name: str = "result") -> DataFrame:
        return self._write(df, name)[1]


def drop_results(df: DataFrame) -> None:
    """Delete the tables in the shared folder that an operator's result is read from; it can't be read afterwards."""
    spark, root = df.sparkSession, filesystem_path(shared_dir(df.sparkSession))
    jvm = spark._jvm
    for name in {x.partition(root + "/")[2].split("/")[0] for x in map(filesystem_path, df.inputFiles()) if x.startswith(root + "/")}:
        p = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def filesystem_path(uri: str) -> str:
    """A URI without ``file:``, whose number of slashes differs between Spark's own spellings."""
    return re.sub("^file:/+", "/", uri)


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of doc_id as text, mod n; a null doc_id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def docs_of(documents: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), with no other column that could clash."""
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), the same on every machine."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of each word met; forgets all when it is full, so memory is bounded."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(words: list[bytes], hashes: WordHashes, size: int) -> np.ndarray:
    """Hashes of the word windows in order; fewer words than ``size`` are one window; none, none."""
    return windows(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), size)


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the windows of ``size`` words, from the hashes of the words."""
    if not len(h):
        return np.empty(0, np.uint64)
    size = min(size, len(h))
    out = h[: len(h) - size + 1] * np.uint64(2 * size + 1)
    for i in range(1, size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[i : len(h) - size + 1 + i]
    return mix(out)


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LETTER[65:91] = _LETTER[97:123]  # A-Z count as a-z
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64


class HashedWords:
    """64-bit hashes of the words of texts, lower-cased A-Z, with no Python object per word.

    A word's hash is the sum of its letters' numbers times the powers of a base, taken from running sums
    over a piece of text. Texts are taken in pieces of about ``piece`` bytes that end between words, so
    memory follows the longest word, not the longest text.
    """

    def __init__(self, piece: int = 1 << 17):
        self.piece, self.up, self.down = piece, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_BASE, -k, 1 << 64))])
        return self.up[:n], self.down[:n]

    def _words(self, raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, first and last bytes); no word crosses one of ``edges``."""
        space = _SPACE[raw]
        before, after = np.ones(len(raw), bool), np.ones(len(raw), bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        inner = edges[(edges > 0) & (edges < len(raw))]
        before[inner], after[inner - 1] = True, True
        first, last = np.flatnonzero(~space & before), np.flatnonzero(~space & after)
        up, down = self._powers(len(raw))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_LETTER[raw] * up, out=sums[1:])
        return mix((sums[last + 1] - sums[first]) * down[first]), first, last

    def __call__(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The hashes of the words of each text of a column without nulls, in order."""
        for h, _, _ in self.spans(column):
            yield h

    def spans(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Hashes, first and last bytes of the words of each text; the places are those in ``raw``, which this sets."""
        column = column.cast(pa.large_binary())
        ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        raw = self.raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        i = 0
        while i < len(column):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + self.piece, side="right")) - 1)
            lo, hi = int(ends[i]), int(ends[j])
            if j == i + 1 and hi - lo > self.piece:
                yield self._long(raw, lo, hi)
            else:
                h, first, last = self._words(raw[lo:hi], ends[i:j] - lo)
                cuts = np.searchsorted(first, ends[i : j + 1] - lo)
                first, last = first + lo, last + lo
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    yield h[a:b], first[a:b], last[a:b]
            i = j

    def _long(self, raw: np.ndarray, lo: int, end: int) -> tuple[np.ndarray, ...]:
        out, none = [], np.empty(0, np.int64)
        while lo < end:
            hi = min(end, lo + self.piece)
            while hi < end and not _SPACE[raw[hi]]:
                hi += 1
            h, first, last = self._words(raw[lo:hi], none)
            out.append((h, first + lo, last + lo))
            lo = hi
        return tuple(map(np.concatenate, zip(*out, strict=True)))

    def words(self, first: np.ndarray, last: np.ndarray) -> pa.Array:
        """The words at some places of ``raw``, lower-cased."""
        sizes = last - first + 1
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        body = _LOWER[self.raw[np.repeat(first - ends[:-1], sizes) + np.arange(ends[-1])]]
        return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(body)]).cast(pa.binary())

    def endings(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A number for the last three bytes of each word (fewer: all), lower-cased, and how many they are."""
        n = np.minimum(last - first + 1, 3)
        out = n << 24
        for i in range(3):
            out |= np.where(n > i, _LOWER[self.raw[np.maximum(last - i, first)]].astype(np.int64) << 8 * i, 0)
        return out


def hashes_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, endings) of words, as ``HashedWords`` has them."""
    own = HashedWords()
    parts = list(own.spans(pa.array(words, pa.binary())))
    h, first, last = map(np.concatenate, zip(*parts, strict=True)) if parts else (np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 2)
    return h, own.endings(first, last)
