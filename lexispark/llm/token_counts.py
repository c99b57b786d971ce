"""Exact token counts of a corpus from its histogram of encoded lengths.

Documents are encoded once and summed by length; whatever the number of documents, what follows
works on one row per distinct length. Suffix sums over the histogram then answer, for every context
limit, how many documents exceed it, how many tokens are left when documents are cut at it, and the
quantile it stands for. The sums are made in two levels (ranges of lengths, then lengths within a
range), so no task sees the whole histogram.

Defined results: null and empty texts have length 0. An empty table has an empty histogram, and
``at_limits`` then gives zeros. Repeated rows count each time; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scratch, docs_of
from .tokens import encoder, vocabulary


def token_length(path: str):
    """Column -> Column: the number of ids of a text column."""

    @F.arrow_udf(T.LongType())
    def length(text: pa.Array) -> pa.Array:
        own = encoder(path)
        return pa.array([len(own.encode(t)) // 4 for t in text.to_pylist()], pa.int64())

    return length


def histogram(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(length, n_docs), one row per distinct length: a written table, so whatever is asked of it encodes nothing again."""
    length = token_length(tokenizer or vocabulary())
    with Scratch(documents.sparkSession, "lengths") as scratch:
        return scratch.keep(docs_of(documents).select(length("text").alias("length")).groupBy("length").agg(F.count("*").alias("n_docs")), "histogram")


def profile(hist: DataFrame, width: int = 1024) -> DataFrame:
    """Per distinct length: what a context limit of that length means for the corpus.

    docs_up_to and docs_over (longer documents), tokens_up_to (in documents up to it), total_tokens,
    truncated_total (sum of min(length, limit)), lost_tokens and share_up_to (of documents).
    """
    h = hist.withColumn("range", F.floor(F.col("length") / width))
    per = h.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("length")).alias("t"))
    # As many rows as length / 1024 of the longest document.
    after = Window.orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    per = per.select("range", F.coalesce(F.sum("d").over(after), zero).alias("d_after"), F.coalesce(F.sum("t").over(after), zero).alias("t_after"), F.sum("d").over(every).alias("total_docs"), F.sum("t").over(every).alias("total_tokens"))
    inside = Window.partitionBy("range").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    h = h.join(per, "range").withColumn("docs_over", F.col("d_after") + F.coalesce(F.sum("n_docs").over(inside), zero)).withColumn("tokens_over", F.col("t_after") + F.coalesce(F.sum(F.col("n_docs") * F.col("length")).over(inside), zero))
    h = h.withColumn("truncated_total", F.col("total_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("length"))
    return h.select("length", "n_docs", (F.col("total_docs") - F.col("docs_over")).alias("docs_up_to"), "docs_over", (F.col("total_tokens") - F.col("tokens_over")).alias("tokens_up_to"), "total_tokens", "truncated_total", (F.col("total_tokens") - F.col("truncated_total")).alias("lost_tokens"), ((F.col("total_docs") - F.col("docs_over")) / F.col("total_docs")).alias("share_up_to"))


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_over, truncated_total) for any limits, also between lengths."""
    sums = []
    for i, x in enumerate(limits):
        sums += [F.sum(F.when(F.col("length") > x, F.col("n_docs")).otherwise(0)).alias(f"o{i}"), F.sum(F.col("n_docs") * F.least("length", F.lit(x))).alias(f"t{i}")]
    stacked = ", ".join(f"{x}L, coalesce(o{i}, 0L), coalesce(t{i}, 0L)" for i, x in enumerate(limits))
    return hist.agg(*sums).selectExpr(f"stack({len(limits)}, {stacked}) as (context_limit, docs_over, truncated_total)")


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the least length that at least this share of documents doesn't exceed."""
    p = profile(hist)
    return p.agg(*(F.min(F.when(F.col("docs_up_to") >= F.ceil(F.lit(s) * (F.col("docs_up_to") + F.col("docs_over"))), F.col("length"))).alias(f"q{i}") for i, s in enumerate(shares))).selectExpr(f"stack({len(shares)}, {', '.join(f'{s}D, q{i}' for i, s in enumerate(shares))}) as (share, length)")
