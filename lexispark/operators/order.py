"""Orders, ranks, prefixes and samples of n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tokens import prefix_key, tokens
from ..sources.shared import Steps


def global_sort(df: DataFrame, key: Column | None = None) -> DataFrame:
    """A total order by the lower-cased n-gram (or ``key``), then the n-gram: range partitions, sorted."""
    return df.orderBy(F.lower("ngram") if key is None else key, "ngram")


def top_vocabulary(totals: DataFrame, n: int) -> DataFrame:
    """The n most frequent n-grams with idx 1..n; ties by n-gram. Only n rows reach one task."""
    top = totals.orderBy(F.col("freq_tot").desc(), "ngram").limit(n)
    return top.withColumn("idx", F.row_number().over(Window.orderBy(F.col("freq_tot").desc(), "ngram")).cast("long"))


def dense_index(totals: DataFrame) -> DataFrame:
    """idx = 1.. over all rows by freq_tot descending, then n-gram, without one task for all of them.

    Rows are cut into ranges of that order and sorted within them, once, as a table in the shared folder: a row's number there is its
    range and its place in it. The sizes of the ranges before it make that its index; they are one row a range. However many rows have one
    frequency or begin alike, ranges are even, as they are cut by the whole order.
    """
    with Steps(totals.sparkSession, "index") as steps:
        order = (F.col("freq_tot").desc(), F.col("ngram"))
        placed = totals.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
        rows = steps.keep(placed.withColumn("_range", F.shiftright("_at", 33)), "rows")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_at").bitwiseAND((1 << 33) - 1)
    return rows.join(sizes, "_range").select(*totals.columns, (F.col("_before") + place + 1).alias("idx"))


def head_slice(df: DataFrame, order: list, start: int, end: int) -> DataFrame:
    """Rows start..end (from 1, both included) of an order."""
    return df.orderBy(*order).offset(start - 1).limit(max(0, end - start + 1))


def first_per_group(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def is_sorted(df: DataFrame, key: str, position: str, descending: bool = False, by: list[str] | None = None) -> DataFrame:
    """Whether ``key`` is in order along ``position`` (within ``by``); a missing key makes it false.

    Without ``by`` the table is cut into ranges of the position: neighbours are compared inside a range,
    and only the edges of the ranges meet in one task.
    """
    if by:
        before = F.lag(key).over(Window.partitionBy(*by).orderBy(position))
        out = df.withColumn("_bad", F.col(key).isNull() | ((before < F.col(key)) if descending else (before > F.col(key))))
        return out.groupBy(*by).agg((F.count_if("_bad") == 0).alias("is_sorted"))
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(position).alias("position"), F.col(key).alias("key")).repartitionByRange("position").sortWithinPartitions("position")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        bad, part = False, TaskContext.get().partitionId()
        for batch in batches:
            keys = batch.column("key")
            if not len(keys):
                continue
            bad |= keys.null_count > 0
            now = keys if last is None else pa.concat_arrays([pa.array([last], keys.type), keys])
            a, b = now.slice(0, len(now) - 1), now.slice(1)
            bad |= bool(pc.any(pc.less(a, b) if descending else pc.greater(a, b)).as_py())
            first, last = keys[0].as_py() if first is None else first, keys[-1].as_py()
        if first is not None or bad:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([bad]), pa.array([first], keys.type), pa.array([last], keys.type)], ["part", "bad", "first", "last"])

    ends = rows.mapInArrow(edges, f"part int, bad boolean, first {kind}, last {kind}")  # one row per range
    before = F.lag("last").over(Window.orderBy("part"))
    wrong = F.col("bad") | F.coalesce((before < F.col("first")) if descending else (before > F.col("first")), F.lit(False))
    return ends.select(wrong.alias("wrong")).agg((F.count_if("wrong") == 0).alias("is_sorted"))


def prefix_histogram(ngrams: DataFrame, depth: int, *sums: str) -> DataFrame:
    """(prefix, total, *sums): n-grams by their prefix key, and the sums of other columns.

    N-grams are counted by their initials as they are first, which is one pass over a string; only the few different ones become keys.
    """
    initials = F.regexp_replace("ngram", r"[ \t\n\r]*([^ \t\n\r])[^ \t\n\r]*[ \t\n\r]*", "$1 ")
    per = ngrams.groupBy(initials.alias("ngram")).agg(F.count("*").alias("total"), *(F.sum(c).alias(c) for c in sums))
    return per.groupBy(prefix_key(tokens(F.col("ngram")), depth).alias("prefix")).agg(*(F.sum(c).alias(c) for c in ("total", *sums)))


def prefix_rollup(histogram: DataFrame, depth: int) -> DataFrame:
    """Totals of every prefix of lengths 0..depth."""
    lengths = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("length")
    return histogram.select("prefix", "total", lengths).groupBy("length", F.expr("substring(prefix, 1, length)").alias("prefix")).agg(F.sum("total").alias("total"))


def buckets(histogram: DataFrame, n: int) -> DataFrame:
    """(prefix, bucket): neighbouring prefixes in about n buckets of like total. The histogram has at most 27 ** depth rows."""
    running = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = F.coalesce(F.sum("total").over(running), F.lit(0)) * n
    return histogram.select("prefix", "total", F.floor(share / F.sum("total").over(every)).cast("long").alias("bucket"))


def assign_buckets(ngrams: DataFrame, bucketed: DataFrame, depth: int) -> DataFrame:
    """Each n-gram with the bucket of its prefix key; keys without one keep a null bucket, none is lost."""
    own = ngrams.withColumn("prefix", prefix_key(tokens(F.col("ngram")), depth))
    return own.join(bucketed.select("prefix", "bucket"), "prefix", "left")


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows (all if fewer), uniform and reproducible: those with the smallest md5 of key and seed."""
    place = F.md5(F.concat(F.col(key), F.lit(f"#{seed}")).cast("binary"))
    return df.orderBy(place, key).limit(n)
