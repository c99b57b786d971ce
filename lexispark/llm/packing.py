"""Best-fit packing of documents into sequences, planned on the histogram of piece lengths.

Documents are encoded once; a document longer than ``size`` is cut into pieces of ``size`` and a last
one. Best-fit decreasing then runs over counts: all pieces of a length are placed at once into the
fullest sequences that still take them, so the plan costs at most some thousand steps (lengths are
at most ``size``) whatever the number of documents. The plan is a list of runs: the pieces of one
length with ranks lo..lo+n-1 take sequences first..first+n-1 at one offset. A piece finds its slot by
its rank within its length: ranks come from one range-partitioned sort plus the counts of the
ranges before, so a length that holds a third of all pieces is spread over many tasks.

Defined results: a null or empty text is one piece with only the end id. Repeated rows are packed each
on its own. An empty table gives no rows. Other columns are ignored. Ties in rank go by doc_id (null
first), piece, start and crc32.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scratch, docs_of
from .tokens import encoder, vocabulary


def plan(counts: dict[int, int], size: int) -> np.ndarray:
    """Runs (length, lo, n, first, offset) of best-fit decreasing over ``counts`` pieces of each length."""
    runs: list[tuple[int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}  # room -> ranges of open sequences (first, n)
    rooms: list[int] = []  # those in free, ascending
    opened = 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in free:
                free[room] = []
                insort(rooms, room)
            free[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, n = free[room].pop()
                if not free[room]:
                    del free[room], rooms[i]
            else:
                room, first, n = size, opened, -(-left // (size // length))
                opened += n
            each = min(room // length, left)  # best fit fills one sequence with as many as it takes
            full = min(n, left // each)
            for j in range(each):
                runs.append((length, rank + j * full, full, first, size - room + j * length))
            rank, left = rank + each * full, left - each * full
            put(room - each * length, first, full)
            put(room, first + full, n - full)
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


PIECE = T.StructType([T.StructField(n, T.LongType()) for n in ("piece", "start", "length", "ids_crc32")])


def pieces(documents: DataFrame, size: int, end_id: int, tokenizer: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32; the ids themselves stay in the task."""

    @F.arrow_udf(T.ArrayType(PIECE))
    def cut(text: pa.Array) -> pa.Array:
        own, end, out = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), []
        for t in text.to_pylist():
            ids = own.encode(t) + end
            out.append([{"piece": i, "start": i * size, "length": len(x) // 4, "ids_crc32": zlib.crc32(x)} for i, x in enumerate(ids[j : j + size * 4] for j in range(0, len(ids), size * 4))])
        return pa.array(out, pa.list_(pa.struct([(n, pa.int64()) for n in PIECE.names])))

    return docs_of(documents).select("doc_id", F.explode(cut("text")).alias("p")).select("doc_id", F.col("p.piece").cast("int").alias("piece"), "p.start", "p.length", "p.ids_crc32")


def best_fit(documents: DataFrame, size: int = 2048, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = documents.sparkSession
    with Scratch(spark, "packing") as scratch:
        order = ("length", F.col("doc_id").asc_nulls_first(), "piece", "start", "ids_crc32")
        cut = scratch.table(pieces(documents, size, end_id, tokenizer or vocabulary()), "pieces")
        dealt = cut.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

        def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, seen = -1, 0
            for batch in batches:
                length = batch.column("length").to_numpy(zero_copy_only=False)
                if not len(length):
                    continue
                fresh = np.flatnonzero(np.concatenate([[length[0] != last], length[1:] != length[:-1]]))
                at = np.arange(len(length)) + seen
                if len(fresh):
                    begins = np.zeros(len(length), np.int64)
                    begins[fresh] = at[fresh]
                    at = at - np.maximum.accumulate(begins)
                last, seen = int(length[-1]), int(at[-1]) + 1
                yield batch.append_column("local_rank", pa.array(at.astype(np.int64)))

        ranked = scratch.table(dealt.mapInArrow(rank, T.StructType(dealt.schema.fields + [T.StructField("local_rank", T.LongType())])), "ranked")
        # At most one row per length and one more per range boundary: size + partitions.
        spans = ranked.groupBy("length", "part").agg(F.count("*").alias("n"))
        before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        spans = spans.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
        runs = plan(counts, size)
        held = spark.sparkContext.broadcast(((runs[:, 0] << 40) + runs[:, 1], runs))

        @F.arrow_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
        def slot(length: pa.Array, rank_in_length: pa.Array) -> pa.Array:
            keys, table = held.value
            r = rank_in_length.to_numpy(zero_copy_only=False)
            own = table[np.searchsorted(keys, (length.to_numpy(zero_copy_only=False) << 40) + r, side="right") - 1]
            return pa.StructArray.from_arrays([pa.array(own[:, 3] + r - own[:, 1]), pa.array(own[:, 4].copy())], ["sequence_id", "offset"])

        placed = ranked.join(F.broadcast(spans), ["length", "part"]).withColumn("s", slot(F.col("length"), F.col("local_rank") + F.col("before")))
        return scratch.keep(placed.select("doc_id", "piece", "start", "length", "ids_crc32", "s.sequence_id", "s.offset"))
