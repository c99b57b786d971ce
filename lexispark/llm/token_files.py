"""Token ids of documents in Simple-8b files: writer, reader and the codec.

A 64-bit word holds a selector in its top 4 bits and as many ids as fit in the other 60 at one width.
Blocks of 65,536 ids are coded alone; the index at the end of a file has each block's offset, so a
block is decoded with one vectorised pass per selector, and blocks can be read apart. Ids of more
than 60 bits are escapes: 0 in the words, and (position, id) in the block's escape list.

File: ``LXS8``; for each block its words, then its escapes (positions as u32, padded to 8 bytes, ids
as u64); then the index: per document id, validity and count; per block offset, ids, words and
escapes; then the counts of documents and blocks, the index's crc32 and ``LXS8`` again. All numbers
are little-endian.

``write_files`` puts documents in ascending doc_id order (nulls first, then by a hash of the text) into one file per
range; files are written under temporary names, renamed when complete, and count once the manifest
table is committed. ``read_files`` gives, per document, the ids before it in the whole corpus, its
count and its crc32, and the ids if asked.

Defined results: a null or empty text has only its end id. Rows that repeat are documents of their
own, one after another. An empty table gives an empty manifest. Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import docs_of, filesystem
from .tokens import encoder, vocabulary

#: Fixed values of the Simple-8b format: (ids in a word, bits of each) of selectors 2 to 15.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
BLOCK, MAGIC = 65_536, b"LXS8"
_COUNTS = np.array([0, 0, *(n for n, _ in SELECTORS)], np.int64)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, positions of escapes) of uint64 ids; at every place the selector that takes most ids."""
    escapes = np.flatnonzero(ids >> np.uint64(60))
    if len(escapes):
        ids = ids.copy()
        ids[escapes] = 0
    n = len(ids)
    high = (ids >> np.uint64(30)).astype(np.float64)
    bits = np.where(high > 0, np.frexp(high)[1] + 30, np.frexp((ids & np.uint64((1 << 30) - 1)).astype(np.float64))[1]).astype(np.uint8)
    widest = {1: bits}
    for p in (2, 4, 8, 16, 32):
        m = widest[p // 2]
        widest[p] = np.maximum(m[: max(0, len(m) - p // 2)], m[p // 2 :])
    chosen = np.full(n, len(SELECTORS) - 1, np.int8)
    for k in range(len(SELECTORS) - 2, -1, -1):  # the last to fit, which takes most ids, stays
        take, width = SELECTORS[k]
        if take <= n:
            p = 1 << (take.bit_length() - 1)
            m = widest[p]
            fits = np.maximum(m[: n - take + 1], m[take - p : n - p + 1]) <= width
            chosen[: n - take + 1][fits] = k
    steps, starts, i = _COUNTS[chosen + 2].tolist(), [], 0
    while i < n:
        starts.append(i)
        i += steps[i]
    at = np.array(starts, np.int64)
    kinds, words = chosen[at], np.empty(len(at), np.uint64)
    for k in np.unique(kinds):
        take, width = SELECTORS[k]
        own = np.flatnonzero(kinds == k)
        w = np.full(len(own), int(k) + 2, np.uint64) << np.uint64(60)
        for j in range(take):
            w |= ids[at[own] + j] << np.uint64(width * j)
        words[own] = w
    return words, escapes


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of a block's words, escapes as 0."""
    kinds = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(_COUNTS[kinds])
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    for k in np.unique(kinds):
        take, width = SELECTORS[k - 2]
        own = np.flatnonzero(kinds == k)
        w, at, mask = words[own], ends[own] - take, np.uint64((1 << width) - 1)
        for j in range(take):
            out[at + j] = (w >> np.uint64(width * j)) & mask
    return out


class Writer:
    """One file; ids are coded block by block, so memory doesn't grow with it but for its index."""

    def __init__(self, sink):
        self.sink, self.pending, self.waiting, self.at, self.total = sink, [], 0, 4, 0
        self.docs: list[tuple] = []
        self.blocks: list[tuple] = []
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.pending.append(ids)
        self.waiting += len(ids)
        self.total += len(ids)
        if self.waiting >= BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.pending).astype(np.uint64) if self.pending else np.empty(0, np.uint64)
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for i in range(0, whole, BLOCK):
            block = ids[i : min(i + BLOCK, whole)]
            words, escapes = pack(block)
            data = words.astype("<u8").tobytes() + escapes.astype("<u4").tobytes() + b"\0" * (len(escapes) % 2 * 4) + block[escapes].astype("<u8").tobytes()
            self.blocks.append((self.at, len(block), len(words), len(escapes)))
            self.sink.write(data)
            self.at += len(data)
        self.pending = [ids[whole:]]
        self.waiting = len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        index = b"".join(np.array(c, t).tobytes() for c, t in (([d or 0 for d, _ in self.docs], "<i8"), ([d is not None for d, _ in self.docs], "u1"), ([n for _, n in self.docs], "<i8"), *(([b[i] for b in self.blocks], "<i8") for i in range(4))))
        self.sink.write(index + struct.pack("<QQI", len(self.docs), len(self.blocks), zlib.crc32(index)) + MAGIC)


class Reader:
    """The index of an open file, and its blocks."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 24)
        docs, blocks, crc, magic = struct.unpack("<QQI4s", source.read(24))
        length = docs * 17 + blocks * 32
        if magic != MAGIC or length + 28 > size:
            raise ValueError("not a whole token file")
        source.seek(size - 24 - length)
        index = source.read(length)
        if zlib.crc32(index) != crc:
            raise ValueError("not a whole token file")
        at = 0

        def column(n: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(index, kind, n, at)
            at += out.nbytes
            return out

        self.ids, self.valid, self.counts = column(docs, "<i8"), column(docs, "u1") > 0, column(docs, "<i8")
        self.blocks = np.stack([column(blocks, "<i8") for _ in range(4)], axis=1) if blocks else np.zeros((0, 4), np.int64)

    def block(self, i: int) -> np.ndarray:
        offset, n, words, escapes = (int(x) for x in self.blocks[i])
        self.source.seek(offset)
        data = self.source.read(words * 8 + (escapes + 1) // 2 * 8 + escapes * 8)
        out = unpack(np.frombuffer(data, "<u8", words))
        if len(out) != n:
            raise ValueError(f"block {i} has {len(out)} ids; the index says {n}")
        if escapes:
            out[np.frombuffer(data, "<u4", escapes, words * 8)] = np.frombuffer(data, "<u8", escapes, len(data) - escapes * 8)
        return out


MANIFEST = T.StructType([T.StructField("shard", T.LongType()), T.StructField("file", T.StringType()), T.StructField("docs", T.LongType()), T.StructField("tokens", T.LongType())])


def write_files(documents: DataFrame, out: str, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """Encode and write ``documents`` (doc_id, text) below ``out``; the manifest, read back."""
    spark, path = documents.sparkSession, tokenizer or vocabulary()
    docs = docs_of(documents)
    # Ties of doc_id, which may be many, are dealt out by a hash of the text; only equal rows stay together.
    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text"))
    ordered = docs.repartitionByRange(*order[:2]).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(out)
        shard, writer = TaskContext.get().partitionId(), None
        name, end, own = f"tokens-{shard:06d}.s8b", np.array([end_id], np.uint32), encoder(path)
        tmp = f"{root}/_temporary/{name}.{uuid.uuid4().hex}"
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):  # few texts at a time as Python objects
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if writer is None:
                    fs.create_dir(f"{root}/_temporary", recursive=True)
                    sink = fs.open_output_stream(tmp)
                    writer = Writer(sink)
                writer.add(doc_id, np.concatenate([np.frombuffer(own.encode(text), "<u4"), end]))
        if writer:
            writer.close()
            sink.close()
            fs.move(tmp, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [name], "docs": [len(writer.docs)], "tokens": [writer.total]})

    ordered.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(f"{out}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{out}/manifest")


def read_files(spark: SparkSession, out: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document in the files."""
    # One row per file; only these are brought into one order.
    manifest = spark.read.schema(MANIFEST).parquet(f"{out}/manifest")
    placed = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.LongType()))] * with_ids)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(out)
        for files in batches:
            for file in files.to_pylist():
                with fs.open_input_file(f"{root}/{file['file']}") as source:
                    reader = Reader(source)
                    crcs, kept = np.zeros(len(reader.counts), np.int64), []
                    doc, left, crc, parts = 0, int(reader.counts[0]) if len(reader.counts) else 0, 0, []
                    for i in range(len(reader.blocks)):
                        ids, at = reader.block(i).astype("<u4"), 0
                        data = memoryview(ids).cast("B")
                        while at < len(ids):
                            n = min(left, len(ids) - at)
                            crc = zlib.crc32(data[at * 4 : (at + n) * 4], crc)
                            if with_ids:
                                parts.append(ids[at : at + n])
                            at, left = at + n, left - n
                            if not left:
                                crcs[doc] = crc
                                if with_ids:
                                    kept.append(np.concatenate(parts).astype(np.int64))
                                doc, crc, parts = doc + 1, 0, []
                                left = int(reader.counts[doc]) if doc < len(reader.counts) else 0
                if doc != file["docs"] or reader.counts.sum() != file["tokens"]:
                    raise ValueError(f"{file['file']} doesn't hold what the manifest says")
                columns = [pa.array(reader.ids, mask=~reader.valid), pa.array(file["base"] + np.cumsum(reader.counts) - reader.counts), pa.array(reader.counts), pa.array(crcs)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.list_(pa.int64()))] * with_ids, schema.names)

    return placed.select("file", "docs", "tokens", "base").repartition(max(1, manifest.count()), "file").mapInArrow(read, schema)
