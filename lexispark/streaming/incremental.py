"""Incremental ingest: a manifest of finished shards, and the same totals as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.corpus import last_wins, merge, parse_tolerant, to_long
from ..operators.vocabularies import pending
from ..sources import shards


def ingest(spark: SparkSession, shards: DataFrame, manifest: DataFrame, corpus: DataFrame, read) -> tuple[DataFrame, DataFrame]:
    """(corpus, manifest) after the shards (column file) that the manifest lacks; ``read`` turns files into a corpus."""
    fresh = pending(shards, manifest, "file")
    return merge(corpus, read(fresh)), manifest.select("file").union(fresh.select("file")).distinct()


def shard_entries(lines: DataFrame, kind: str = "all") -> DataFrame:
    """file, ngram, years of lines (file, line, value) of shards; of an n-gram's lines in one shard the last wins."""
    parsed = parse_tolerant(lines.where("value is not null"), kind, ("file", "line")).where(F.size("years") > 0)
    return last_wins(parsed.select("file", "ngram", "line", "years"), ["file", "ngram"], ["line"]).select("file", "ngram", "years")


def shard_report(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """Per shard: lines read, entries kept, and lines that couldn't be read."""
    read = lines.groupBy("file").agg(F.count_if(F.col("error").isNull()).alias("lines"), F.count("error").alias("errors"))
    kept = entries.groupBy("file").agg(F.count("*").alias("entries"))
    return read.join(kept, "file", "left").select("file", "lines", F.coalesce("entries", F.lit(0)).alias("entries"), "errors")


def ingest_shards(spark: SparkSession, path: str, manifest: DataFrame, corpus: DataFrame, kind: str = "all", **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, manifest, report) after the shards of a folder that the manifest (column file) lacks; ``options`` as of ``read_shards``.

    An n-gram that several shards hold is summed. The manifest is a list of shard names, some ten thousand at most.
    """
    lines = shards.read_shards(spark, path, done=sorted(r["file"] for r in manifest.select("file").distinct().collect()), **options)
    entries = shard_entries(lines, kind)
    report = shard_report(lines, entries)
    return merge(corpus, to_long(entries)), manifest.select("file").union(report.select("file")).distinct(), report


def stream_totals(counts: DataFrame) -> DataFrame:
    """Running totals of a stream (or table) of (ngram, year, freq, doc)."""
    return counts.groupBy("ngram", "year").agg(F.sum("freq").alias("freq"), F.sum("doc").alias("doc"))


#: Keeps keyed state on the executors' disks, with changes in the checkpoint, instead of on the heap.
STATE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_stream(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Take in all files there are, each once, into the table of totals at ``path`` (read it by ``current``).

    Running sums are keyed state; a batch writes the totals of its own keys alone, as path/changes/v=<batch>, so its cost follows
    the batch and not the table. A batch that is tried again writes the same version again, and a query that is
    started anew goes on from its checkpoint.
    """
    spark = counts.sparkSession

    def add(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/v={i}")

    was = spark.conf.get(STATE[0])
    spark.conf.set(*STATE)
    try:
        return stream_totals(counts).writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(STATE[0], was)


def versions(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """(version of the newest complete base or -1, versions of complete changes after it)."""
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def complete(kind: str) -> list[int]:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}")
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}/{n}/_SUCCESS")))

    base = max(complete("base"), default=-1)
    return base, [v for v in complete("changes") if v > base]


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table of totals: of each key the row of its last version."""
    base, changes = versions(spark, path)
    kind = "ngram string, year int, freq long, doc long"
    rows = spark.createDataFrame([], f"{kind}, version long")
    for name, v in [("base", base)] * (base >= 0) + [("changes", v) for v in changes]:
        rows = rows.union(spark.read.schema(kind).parquet(f"{path}/{name}/v={v}").withColumn("version", F.lit(v).cast("long")))
    return last_wins(rows, ["ngram", "year"], ["version"]).select("ngram", "year", "freq", "doc")


def compact(spark: SparkSession, path: str) -> int:
    """Write the table as one base, then drop what that holds; its version. To be run now and then, with the stream stopped or not.

    The base counts once it is complete, so a compaction that breaks off changes nothing; what it should have dropped goes with the next one.
    """
    base, changes = versions(spark, path)
    if changes:
        base = changes[-1]
        current(spark, path).write.mode("overwrite").parquet(f"{path}/base/v={base}")
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for kind, least in (("base", base), ("changes", base + 1)):
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}")
        for x in fs.listStatus(folder) if fs.exists(folder) else []:
            if x.getPath().getName().startswith("v=") and int(x.getPath().getName()[2:]) < least:
                fs.delete(x.getPath(), True)
    return base


def windowed_events(events: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events per type and tumbling window; on a stream, rows later than ``late`` are dropped."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n_events"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n_events", "total")
