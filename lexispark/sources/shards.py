"""Shard files of lines (gzip, LZ4 frames, plain) as a data source: one partition a shard, opened and decoded in its task as a stream.

Spark's own readers have no LZ4 frames, drop line numbers, and give a bad byte a replacement character without a word. Here a
line comes with its file and number, so that of repeated lines the last can win; a line that isn't UTF-8 comes with an error and
no value, and so does the place where a file breaks off. Nothing holds a whole file, so its size doesn't matter.

The sink writes lines as LZ4 frames or gzip: a task writes under a temporary name, and the driver's commit gives the files of
complete tasks their names, those of an overwritten table going first. A task that is tried again leaves only a temporary file, which goes with the commit.
"""

from __future__ import annotations

import gzip
import os
import random
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

LINES = "file string, line long, value string, error string"
_LINES = pa.schema([("file", pa.string()), ("line", pa.int64()), ("value", pa.string()), ("error", pa.string())])
NAME, TEMPORARY = "line_shards", "_temporary"


def filesystem(uri: str):
    """(pyarrow file system, path) of a folder or file, usable in tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if re.match(r"\w+:", uri) else f"file://{os.path.abspath(uri)}")


def list_shards(path: str, pattern: str = ".*", file_range: tuple[int, int] | None = None, seed: int | None = None) -> list[str]:
    """The files of a folder whose names match, in order of name; cut to an inclusive range, then in an order drawn from ``seed``."""
    from pyarrow import fs

    own, root = filesystem(path)
    info = own.get_file_info(root)
    names = [root] if info.type == fs.FileType.File else [x.path for x in own.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.File]
    names = sorted(x for x in names if not os.path.basename(x).startswith(("_", ".")) and re.fullmatch(pattern, os.path.basename(x)))
    if file_range is not None:
        lo, hi = file_range
        if not 0 <= lo <= hi < len(names):
            raise ValueError(f"file range {file_range} is not within 0..{len(names) - 1}")
        names = names[lo : hi + 1]
    if seed is not None:
        random.Random(seed).shuffle(names)
    return names


def find_one(path: str, pattern: str) -> str:
    """The one file of a folder whose name matches; none or several raise."""
    found = list_shards(path, pattern)
    if len(found) != 1:
        raise ValueError(f"{len(found)} files of {path} match {pattern!r}; exactly one is needed")
    return found[0]


def _opened(own, path: str):
    if path.endswith(".lz4"):
        return pa.CompressedInputStream(own.open_input_stream(path, compression=None), "lz4")
    stream = own.open_input_stream(path, compression=None)
    return gzip.GzipFile(fileobj=stream) if path.endswith(".gz") else stream


def lines_of(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    rest, read = b"", getattr(stream, "read1", stream.read)  # gzip: what a file that breaks off still holds
    while block := read(chunk):
        *whole, rest = (rest + block).split(b"\n")
        yield from whole
    if rest:
        yield rest


@dataclass
class Shard(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, options):
        span, seed = options.get("range"), options.get("seed")
        self.path, self.pattern = options["path"], options.get("pattern", ".*")
        self.range = tuple(map(int, span.split("-"))) if span else None
        self.seed = int(seed) if seed is not None else None
        self.skip = set(filter(None, options.get("done", "").split("\n")))

    def partitions(self) -> list[InputPartition]:
        return [Shard(p) for p in list_shards(self.path, self.pattern, self.range, self.seed) if os.path.basename(p) not in self.skip]

    def read(self, partition: Shard | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # without any shard Spark asks for one partition all the same
            return
        own, _ = filesystem(self.path)
        name, held, size, at = os.path.basename(partition.path), [], 0, 0

        def batch() -> pa.RecordBatch:
            columns = [[name] * len(held), *map(list, zip(*held, strict=True))]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LINES, strict=True)], schema=_LINES)

        try:
            if own.get_file_info(partition.path).size:
                with _opened(own, partition.path) as stream:
                    for line in lines_of(stream):
                        at += 1
                        size += len(line)
                        try:
                            held.append((at, line.removesuffix(b"\r").decode(), None))
                        except UnicodeDecodeError as e:
                            held.append((at, None, f"not UTF-8: {e.reason} at byte {e.start}"))
                        if len(held) >= 5000 or size >= 4 << 20:
                            yield batch()
                            held, size = [], 0
        except (OSError, EOFError, gzip.zlib.error, pa.ArrowException) as e:
            held.append((at + 1, None, f"the file breaks off: {str(e)[:200]}"))
        if held:
            yield batch()


@dataclass
class _Written(WriterCommitMessage):
    path: str | None


class _Writer(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite, self.codec, self.job = options["path"], overwrite, options.get("codec", "lz4"), uuid.uuid4().hex[:12]
        if self.codec not in ("lz4", "gzip"):
            raise ValueError(f"codec must be lz4 or gzip, not {self.codec!r}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        own, root = filesystem(self.path)
        folder = f"{root}/{TEMPORARY}-{self.job}"
        own.create_dir(folder, recursive=True)
        path, n = f"{folder}/{uuid.uuid4().hex}", 0
        with pa.CompressedOutputStream(own.open_output_stream(path), self.codec) as out:
            for batch in iterator:
                lines = batch.column(0).cast(pa.binary()).to_pylist()
                n += len(lines)
                if lines:
                    out.write(b"\n".join(x or b"" for x in lines) + b"\n")
        return _Written(path if n else None)

    def commit(self, messages: list) -> None:
        own, root = filesystem(self.path)
        own.create_dir(root, recursive=True)
        old = list_shards(self.path, r"part-.*") if self.overwrite else []
        for path in old:
            own.delete_file(path)
        written = [m.path for m in messages if m is not None and m.path]
        for i, path in enumerate(written):
            own.move(path, f"{root}/part-{i:05d}-of-{len(written):05d}-{self.job}.{'lz4' if self.codec == 'lz4' else 'gz'}")
        self._clear(own, root)
        with own.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list) -> None:
        self._clear(*filesystem(self.path))

    def _clear(self, own, root: str) -> None:
        from pyarrow import fs

        if own.get_file_info(f"{root}/{TEMPORARY}-{self.job}").type == fs.FileType.Directory:
            own.delete_dir(f"{root}/{TEMPORARY}-{self.job}")


class LineShards(DataSource):
    """``spark.read.format("line_shards")``; options path, pattern (of names), range ("0-4"), seed, done (names, one a line), codec (of the sink)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options, overwrite)


def read_shards(spark: SparkSession, path: str, pattern: str = ".*", file_range: tuple[int, int] | None = None, seed: int | None = None, done: list[str] | None = None) -> DataFrame:
    """file, line (from 1), value and error of every line; ``done`` names files to leave out."""
    spark.dataSource.register(LineShards)
    options = {"path": path, "pattern": pattern, "range": file_range and "{}-{}".format(*file_range), "seed": seed, "done": done and "\n".join(done)}
    return spark.read.format(NAME).options(**{k: str(v) for k, v in options.items() if v is not None}).load()


def write_shards(lines: DataFrame, path: str, codec: str = "lz4", mode: str = "overwrite") -> None:
    """One file a partition of the first column, a line a row; null is an empty line."""
    lines.sparkSession.dataSource.register(LineShards)
    first = lines.select(F.col(f"`{lines.columns[0]}`").cast("string").alias("value"))
    first.write.format(NAME).option("codec", codec).mode(mode).save(path)


def write_jsonl_shards(rows: DataFrame, path: str, codec: str = "lz4", mode: str = "overwrite") -> None:
    """Rows as JSON lines in LZ4 frames or gzip."""
    write_shards(rows.select(F.to_json(F.struct(*rows.columns)).alias("value")), path, codec, mode)


def read_jsonl_shards(spark: SparkSession, path: str, schema, **options) -> DataFrame:
    """Rows of JSON lines; lines that can't be read or parsed are left out (``read_shards`` tells which)."""
    rows = read_shards(spark, path, **options).where(F.trim("value") != "")
    return rows.select(F.from_json("value", schema).alias("r")).where("r is not null").select("r.*")
