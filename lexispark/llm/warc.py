"""WARC archives of pages: a deterministic sharded writer and a reader that verifies.

``write_archives`` cuts the pages into ranges of page_id, sorts each range, and writes one gzip member
per record, starting a new file once the current one has reached ``file_bytes`` compressed. Headers
and digests (SHA-1 of payload and block) are made anew. A payload of at least ``revisit_bytes`` bytes
is stored once, with its largest page_id; other records of it are revisits of that record.

Records are ordered by page_id and, below it, by a hash of digest and url (``spread``), so null and
repeated page_ids are cut like any others. The range bounds come from the keys whose hashes lie below a
limit (some ``per_shard`` for each range), so the same pages give the same files byte for byte, whatever
the cluster does. There are at most ``most_shards`` ranges, so what the driver reads has a bound at any size. A task writes under temporary names and renames its
files when a range is complete; the manifest (one row per file: shard, file, records, bytes, digest)
is a table whose job commit makes the archive valid. Files that it doesn't name don't count.

Defined results: null html is an empty payload. A null page_id sorts first and is
smaller than any other when revisits are decided. Rows equal in page_id, payload and url stay in one range. Rows that repeat the largest page_id of a payload
are all responses, so nothing refers to itself. Null urls give no WARC-Target-URI. An empty table
gives an empty manifest and an empty read. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, filesystem, shared_dir

MANIFEST = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("file", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("sha1", T.StringType())])
RECORDS = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("file", T.StringType()), T.StructField("payload", T.BinaryType())])
#: Fixed values of the WARC 1.1 format.
VERSION, PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _member(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = VERSION + b"".join(f"\r\n{k}: {v}".encode() for k, v in headers) + b"\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head + block + b"\r\n\r\n") + z.flush()


def record(page_id, again: str, url, payload: bytes, size: int, digest: bytes, refers_to, date: str, level: int) -> bytes:
    """The gzip member of one page; ``again`` tells apart the records of a repeated page_id (empty: the first)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'null' if page_id is None else page_id}{again and f':{again}'}>"), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)))
    if refers_to is not None:
        headers += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    headers += [("WARC-Payload-Digest", _base32(digest)), ("WARC-Block-Digest", _base32(hashlib.sha1(block).digest())), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _member(headers, block, level)


class _Files:
    """The files of one shard: temporary names until the shard is complete."""

    def __init__(self, out: str, shard: int, file_bytes: int, date: str, level: int):
        self.fs, self.root = filesystem(out)
        self.shard, self.file_bytes, self.date, self.level = shard, file_bytes, date, level
        self.done: list[list] = []
        self.sink = None

    def add(self, member: bytes) -> None:
        if self.sink is None:
            name = f"pages-{self.shard:06d}-{len(self.done):05d}.warc.gz"
            self.tmp = f"{self.root}/_temporary/{name}.{uuid.uuid4().hex}"
            self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
            self.sink, self.sha, self.row = self.fs.open_output_stream(self.tmp), hashlib.sha1(), [self.shard, name, 0, 0]
            self._put(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{name}>"), ("WARC-Date", self.date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", "0")], b"", self.level))
        self._put(member)
        self.row[2] += 1
        if self.row[3] >= self.file_bytes:
            self._roll()

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.sha.update(data)
        self.row[3] += len(data)

    def _roll(self) -> None:
        self.sink.close()
        self.done.append([*self.row, self.sha.hexdigest(), self.tmp])
        self.sink = None

    def commit(self) -> list[tuple]:
        """A second attempt at a shard renames over files of equal content."""
        if self.sink is not None:
            self._roll()
        for row in self.done:
            self.fs.move(row[5], f"{self.root}/{row[1]}")
        return [tuple(row[:5]) for row in self.done]


LOWEST = np.iinfo(np.int64).min


def _bounds(ids: DataFrame, rows: int, shards: int, per_shard: int) -> tuple[np.ndarray, np.ndarray]:
    """Where ranges begin: page_id (null: the lowest number) and spread, of some ``per_shard * shards`` keys with small hashes.

    A range begins with all records of its first page_id, unless several keys of that were drawn.
    """
    none = np.zeros(0, np.int64)
    if shards == 1:
        return none, none
    limit = min(1 << 31, (per_shard * shards << 31) // max(1, rows) + 1)
    drawn = ids.where(F.pmod(F.xxhash64("page_id", "spread"), F.lit(1 << 31)) < limit).select(F.coalesce("page_id", F.lit(LOWEST)).alias("page"), "spread").distinct().toArrow()
    page, spread = (drawn[c].to_numpy() for c in ("page", "spread"))
    order = np.lexsort((spread, page))
    page, spread = page[order], spread[order]
    _, place, times = np.unique(page, return_inverse=True, return_counts=True)
    spread = np.where(times[place] > 1, spread, LOWEST)
    at = np.unique((np.arange(1, shards) * len(page)) // shards) if len(page) else none
    return page[at], spread[at]


def _shards(bounds: tuple[np.ndarray, np.ndarray], page: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """The range of each key: how many bounds aren't above it."""
    lo, hi = (np.searchsorted(bounds[0], page, side=x) for x in ("left", "right"))
    out = lo.copy()
    for k in np.unique(lo[lo < hi]).tolist():  # ranges that begin with the same page_id
        own = np.flatnonzero((lo == k) & (lo < hi))
        out[own] = k + np.searchsorted(bounds[1][k : hi[own[0]]], spread[own], side="right")
    return out.astype(np.int32)


def write_archives(pages: DataFrame, out: str, shard_bytes: int = 64 << 20, file_bytes: int = 32 << 20, revisit_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z", level: int = 6, per_shard: int = 64, most_shards: int = 16_384) -> DataFrame:
    """Write the archive of ``pages`` (page_id, url, html) below ``out``; the manifest, read back.

    A range is a task of about ``shard_bytes`` of payload, more beyond ``most_shards`` of them (6 GB at 100 TB;
    files are rolled inside it). The driver reads some ``per_shard`` keys of 16 bytes for each, so 17 MB at most.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("size", F.octet_length("payload").cast("long")).withColumn("spread", F.xxhash64("digest", "url"))
    with Scratch(spark, "warc") as scratch:
        # What is a revisit is decided on ids, digests and sizes alone; payloads move once, to their shard.
        ids = scratch.table(rows.select("page_id", "digest", "size", "spread"), "digests")
        large = ids.where(F.col("size") >= revisit_bytes)
        shared = large.groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id")
        revisits = large.join(shared, "digest").where(F.coalesce("page_id", F.lit(LOWEST)) < F.col("first_id")).select("page_id", "digest", "spread", "first_id").distinct()
        total, n = ids.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
        shards = min(most_shards, max(1, math.ceil(total / shard_bytes)))
        bounds = spark.sparkContext.broadcast(_bounds(ids, n, shards, per_shard))

        @F.arrow_udf(T.IntegerType())
        def shard_of(page: pa.Array, spread: pa.Array) -> pa.Array:
            return pa.array(_shards(bounds.value, page.to_numpy(zero_copy_only=False), spread.to_numpy(zero_copy_only=False)), pa.int32())

        # A revisit's mark goes to its shard as a row before the records of that page and payload.
        none = lambda kind: F.lit(None).cast(kind)
        marks = revisits.select("page_id", none("string").alias("url"), none("binary").alias("payload"), none("long").alias("size"), "digest", "spread", F.col("first_id").alias("refers_to"))
        placed = marks.union(rows.select("page_id", "url", "payload", "size", "digest", "spread", none("long").alias("refers_to"))).withColumn("shard", shard_of(F.coalesce("page_id", F.lit(LOWEST)), "spread"))
        placed = placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "spread", "digest", F.col("size").asc_nulls_first(), F.col("url").asc_nulls_first())

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, last, again, mark, cut = None, None, 0, (None, None), None
            for batch in batches:
                done = []
                for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "page_id", "url", "payload", "size", "digest", "refers_to", "spread")), strict=True):
                    shard, page_id = row[0], row[1]
                    if files is None or files.shard != shard:
                        done += files.commit() if files else []
                        files, last, mark = _Files(out, shard, file_bytes, date, level), (), (None, None)
                        # The page_id that this range begins with, if the range before may have some of its records.
                        page, spread = (x[shard - 1] if shard else LOWEST for x in bounds.value)
                        cut = page if spread != LOWEST else None
                    if row[4] is None:
                        mark = ((page_id, row[5], row[7]), row[6])
                        continue
                    refers_to = mark[1] if mark[0] == (page_id, row[5], row[7]) else None
                    again = again + 1 if last == (page_id,) else 0
                    last = (page_id,)
                    split = cut is not None and (LOWEST if page_id is None else page_id) == cut
                    name = f"{shard}.{again}" if split else str(again) if again else ""
                    files.add(record(page_id, name, row[2], row[3], row[4], row[5], refers_to, date, level))
                if done:
                    yield _manifest(done)
            if files:
                yield _manifest(files.commit())

        placed.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(f"{out}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{out}/manifest")


def _manifest(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], MANIFEST.names)


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an open WARC file, one gzip member at a time."""
    data = stream.read(1 << 20)
    while data:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not data:
                raise ValueError("a WARC file ends inside a record")
            parts.append(z.decompress(data))
            data = z.unused_data if z.eof else stream.read(1 << 20)
        text = b"".join(parts)
        head, _, rest = text.partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers = dict(x.decode().split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        if rest[size:] != b"\r\n\r\n":
            raise ValueError(f"a record's length is wrong: {headers}")
        yield headers, rest[:size]
        data = data or stream.read(1 << 20)


def _id(urn: str) -> int | None:
    x = urn.strip("<>").split(":")[2]
    return None if x == "null" else int(x)


def read_archives(spark: SparkSession, out: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the files in the manifest; digests, lengths and counts are verified."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{out}/manifest")
    schema = RECORDS if with_payload else T.StructType(RECORDS.fields[:-1])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for file in files.itertuples():
                fs, root = filesystem(out)
                rows, seen = [], 0
                with fs.open_input_stream(f"{root}/{file.file}", compression=None) as stream:
                    for headers, block in records(stream):
                        kind = headers["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:"))
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        whole = hashlib.sha1(payload).digest() == digest and len(payload) == size
                        if _base32(hashlib.sha1(block).digest()) != headers["WARC-Block-Digest"] or (kind == "response") != whole and not (kind == "revisit" and not size):
                            raise ValueError(f"a digest doesn't fit in {file.file}: {headers['WARC-Record-ID']}")
                        seen += 1
                        rows.append((_id(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), size, digest.hex(), kind, _id(headers["WARC-Refers-To"]) if kind == "revisit" else None, file.file, payload if kind == "response" else None)[: len(schema)])
                        if len(rows) >= 500:
                            yield _frame(rows, schema)
                            rows = []
                if seen != file.records:
                    raise ValueError(f"{file.file} has {seen} records; the manifest says {file.records}")
                if rows:
                    yield _frame(rows, schema)

    return manifest.repartition(max(1, manifest.count()), "file").mapInPandas(read, schema)


def _frame(rows: list[tuple], schema: T.StructType) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=schema.names)
    return df.assign(page_id=df["page_id"].astype("Int64"), refers_to=df["refers_to"].astype("Int64"))


def archive_dir(spark: SparkSession, name: str = "warc") -> str:
    """A new folder for an archive in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
