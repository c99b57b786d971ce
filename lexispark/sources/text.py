"""Reading and writing corpora: raw lines, JSON lines (also in LZ4 frames), packed triples, Parquet."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import ngram_type
from ..schema import CORPUS, EVALUATION, NESTED, VECTORS, YEAR_COUNT


@dataclass(frozen=True)
class Layout:
    """Where the tables of a corpus lie below one folder."""

    root: str
    ngram_size: int

    def __getattr__(self, table: str) -> str:
        if table not in ("raw", "corpus", "vocabulary", "yearly", "models", "evaluation", "manifest", "bad_records"):
            raise AttributeError(table)
        return f"{self.root.rstrip('/')}/{self.ngram_size}grams/{table}"

    def shard_pattern(self) -> str:
        """The names of raw shards."""
        return rf"{self.ngram_size}-\d{{5}}-of-\d{{5}}\.gz"


def select_shards(names: list[str], layout: Layout, file_range: tuple[int, int] | None = None) -> list[str]:
    """Shard names in order, cut to an inclusive range; a range out of bounds raises."""
    own = sorted(n for n in names if re.search(layout.shard_pattern() + "$", n))
    if file_range is None:
        return own
    lo, hi = file_range
    if not 0 <= lo <= hi < len(own):
        raise ValueError(f"file range {file_range} is not within 0..{len(own) - 1}")
    return own[lo : hi + 1]


def raw_lines(spark: SparkSession, paths, kind: str = "all", partitions: int | None = None) -> DataFrame:
    """value and file of raw lines (plain or gzip), cut to an n-gram type before anything is parsed.

    Gzip files can't be split; ``partitions`` deals their lines out after the scan.
    """
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"))
    out = lines.where(ngram_type(kind)(F.get(F.split("value", "\t"), 0)))
    return out.repartition(partitions) if partitions else out


def read_jsonl(spark: SparkSession, paths, schema=NESTED) -> DataFrame:
    return spark.read.schema(schema).json(paths)


def write_jsonl(corpus: DataFrame, path: str, compression: str = "gzip", mode: str = "overwrite") -> None:
    """mode 'ignore' leaves what exists, 'overwrite' replaces it."""
    corpus.write.mode(mode).option("compression", compression).json(path)


def read_lz4_jsonl(spark: SparkSession, paths, schema=NESTED, chunk: int = 1 << 20) -> DataFrame:
    """JSON lines of LZ4 frame files, which Spark's own codec can't read.

    A compressed file is one value of one task (2 GB at most); what it holds is decoded as a stream.
    Empty files and empty frames give no rows.
    """
    files = spark.read.format("binaryFile").load(paths)

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa

        for df in batches:
            for content in df["content"]:
                if not content:
                    continue
                rest = b""
                with pa.CompressedInputStream(pa.BufferReader(content), "lz4") as stream:
                    while block := stream.read(chunk):
                        *whole, rest = (rest + block).split(b"\n")
                        yield pd.DataFrame({"value": [x.decode("utf-8", "replace") for x in whole if x.strip()]})
                if rest.strip():
                    yield pd.DataFrame({"value": [rest.decode("utf-8", "replace")]})

    return files.select("content").mapInPandas(lines, "value string").select(F.from_json("value", schema).alias("r")).where("r is not null").select("r.*")


def valid_lz4(spark: SparkSession, paths) -> DataFrame:
    """(file, valid): whether a file is a whole LZ4 frame."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa

        def whole(content: bytes) -> bool:
            try:
                with pa.CompressedInputStream(pa.BufferReader(content), "lz4") as stream:
                    while stream.read(1 << 20):
                        pass
                return True
            except (OSError, pa.ArrowException):
                return False

        for df in batches:
            yield pd.DataFrame({"file": df["path"], "valid": [whole(c) for c in df["content"]]})

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(check, "file string, valid boolean")


def unpack_triples(packed: DataFrame, column: str = "value", width: int = 8) -> DataFrame:
    """``years`` from little-endian unsigned triples (year, freq, doc) of 4 or 8 bytes each, in the JVM."""
    size = 3 * width

    def number(i, at: int):
        part = F.substring(F.col(column), (i * size + at * width + 1).cast("int"), F.lit(width))
        swapped = F.reverse(F.transform(F.sequence(F.lit(1), F.lit(width)), lambda k: F.hex(F.substring(part, k.cast("int"), F.lit(1)))))
        return F.conv(F.array_join(swapped, ""), 16, 10).cast("bigint")

    n = F.floor(F.octet_length(F.col(column)) / size)
    years = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.struct(number(i, 0).cast("int").alias("year"), number(i, 1).alias("freq"), number(i, 2).alias("doc")))).otherwise(F.array().cast(f"array<{YEAR_COUNT.simpleString()}>"))
    return packed.withColumn("years", years)


def pack_triples(rows: list[tuple[int, int, int]], width: int = 8) -> bytes:
    """A packed value, for exchange and tests."""
    return struct.pack("<" + ("Q" if width == 8 else "I") * 3 * len(rows), *(x for r in rows for x in r))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CORPUS).parquet(path)


def write_corpus(corpus: DataFrame, path: str, mode: str = "overwrite") -> None:
    corpus.select(CORPUS.names).write.mode(mode).parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VECTORS).parquet(path)


def write_vectors(vectors: DataFrame, path: str, mode: str = "overwrite") -> None:
    vectors.write.mode(mode).partitionBy("year").parquet(path)


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVALUATION).csv(path, header=True)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True)


#: The column that names a model's year, and the comment mark and section mark of evaluation files.
MODEL_YEAR, COMMENT, SECTION = r"w2v_y(\d{4})", "#", ":"


def model_files(spark: SparkSession, folder: str) -> DataFrame:
    """(model, year, path) of the model files below a folder, from their names; other files don't count."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("model"), "path")
    return named.withColumn("year", F.nullif(F.regexp_extract("model", MODEL_YEAR, 1), F.lit("")).cast("int")).where("year is not null").select("model", "year", "path")


def read_word_pairs(spark: SparkSession, paths) -> DataFrame:
    """(word1, word2, score) of lines of two words and a number between TABs; comments and other lines go."""
    p = F.split(F.trim("value"), "\t")
    rows = spark.read.text(paths).where(~F.startswith("value", F.lit(COMMENT)))
    return rows.select(F.lower(F.get(p, 0)).alias("word1"), F.lower(F.get(p, 1)).alias("word2"), F.get(p, 2).try_cast("double").alias("score")).where("score is not null")


def read_analogies(spark: SparkSession, paths) -> DataFrame:
    """(a, b, c, d) of lines of four words; section lines and others go."""
    p = F.split(F.lower(F.trim("value")), r"\s+")
    rows = spark.read.text(paths).where(~F.startswith("value", F.lit(SECTION)))
    return rows.where(F.size(p) == 4).select(*(F.get(p, i).alias(c) for i, c in enumerate("abcd")))


def read_buckets(spark: SparkSession, paths) -> DataFrame:
    """(prefix, bucket) of lines of a prefix, a TAB and a bucket number."""
    p = F.split("value", "\t")
    return spark.read.text(paths).select(F.get(p, 0).alias("prefix"), F.get(p, 1).try_cast("bigint").alias("bucket")).where("bucket is not null")


def read_bucket_list(spark: SparkSession, path: str) -> DataFrame:
    """(prefix, total, ord) of a JSON file with one array of prefixes, or of pairs of a prefix and its total, in the array's order."""
    items = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("at", "item"))
    pair = F.from_json("item", "array<string>")
    is_pair = F.startswith("item", F.lit("["))
    return items.select(F.when(is_pair, F.get(pair, 0)).otherwise(F.col("item")).alias("prefix"), F.when(is_pair, F.get(pair, 1).try_cast("bigint")).alias("total"), F.col("at").cast("long").alias("ord"))


def write_bucket_list(buckets: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON array of [prefix, total] in the order ``ord``; a list of buckets is small."""
    pair = F.to_json(F.struct(F.col("prefix").alias("p"), F.col("total").alias("t")))
    pair = F.regexp_replace(F.regexp_replace(F.regexp_replace(pair, r'^\{"p":', "["), r',"t":(\d+)\}$', ",$1]"), r"\}$", "]")
    whole = buckets.agg(F.sort_array(F.collect_list(F.struct("ord", pair.alias("pair")))).alias("b"))
    whole.select(F.concat(F.lit("["), F.array_join(F.transform("b", lambda x: x["pair"]), ","), F.lit("]")).alias("value")).coalesce(1).write.mode(mode).text(path)


def write_vocabulary(vocabulary: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Two forms of a vocabulary (ngram, freq_tot, idx): its n-grams as lines, and the whole as a Parquet table to look up by n-gram."""
    vocabulary.select("ngram").write.mode(mode).text(f"{folder}/match_list")
    vocabulary.write.mode(mode).parquet(f"{folder}/lookup")
