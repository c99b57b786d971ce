"""Buckets of n-grams by prefixes of different lengths: cutting a prefix trie to a target size, and the join with a list of prefixes.

Keys are the first letters of an n-gram's tokens (``functions.tokens.prefix_key``), so a trie over them has at most 27 ** depth
leaves, however large the corpus is; only its histogram is worked on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tokens import prefix_key, tokens
from ..sources.shared import Steps
from .corpus import _once


def prefix_totals(histogram: DataFrame) -> DataFrame:
    """(prefix, length, total, above) of every prefix of the keys, all of one length, of a histogram (prefix, total).

    ``above`` is the total of the prefix one letter shorter, which is that of all its extensions; null for the empty one.
    """
    every = histogram.select("prefix", "total", F.explode(F.sequence(F.lit(0), F.length("prefix"))).alias("length"))
    sums = every.groupBy("length", F.expr("left(prefix, length)").alias("prefix")).agg(F.sum("total").alias("total"))
    siblings = Window.partitionBy("length", F.expr("left(prefix, length - 1)"))  # at most 27
    return sums.select("prefix", "length", "total", F.when(F.col("length") > 0, F.sum("total").over(siblings)).alias("above"))


def partition(histogram: DataFrame, n: int = 20, max_depth: int = 3, rounds: int = 5) -> DataFrame:
    """(prefix, total, ord): the trie of a histogram (prefix, total; keys of one length) cut into about n buckets.

    From the root, a prefix with more than the target is split into its extensions, down to ``max_depth`` letters and never to
    whole keys. Totals shrink downwards, so a prefix is a bucket if the one above it is over the target, and it itself isn't or can't be split.
    The target is the share of one of n, and grows or shrinks by a tenth up to ``rounds`` times while there are too many or too few buckets.
    The histogram is made once: its prefix sums are a table, and all targets that can come up are counted in one pass over that. Buckets don't overlap,
    and every key has one. An empty histogram gives none.
    """
    with Steps(histogram.sparkSession, "buckets") as steps:
        every = steps.table(prefix_totals(histogram), "sums")
        whole, deepest = every.agg(F.max("total"), F.max("length")).first()
        most = min(max_depth, max(0, (deepest or 0) - 1))

        def is_bucket(target: float) -> Column:
            return (F.col("length") <= most) & ((F.col("total") <= target) | (F.col("length") == most)) & (F.col("above").isNull() | (F.col("above") > target))

        # Targets as a binary heap: from the k-th on, the 2k-th is a tenth larger and the next a tenth smaller.
        targets = [(whole or 0) / n]
        for k in range(1, 1 << rounds):
            targets += [targets[k - 1] * 1.1, targets[k - 1] * 0.9]
        counts, at = every.agg(*(F.count_if(is_bucket(t)) for t in targets)).first(), 1
        for _ in range(rounds):
            if counts[at - 1] != n:
                at = 2 * at + (counts[at - 1] < n)
        out = every.where(is_bucket(targets[at - 1]))
        order = Window.orderBy("prefix")  # at most 27 ** max_depth rows
        return steps.keep(out.select("prefix", "total", (F.row_number().over(order) - 1).cast("long").alias("ord")))


def initials(ngram: Column, depth: int = 5) -> Column:
    """The first letters of an n-gram's first tokens, lower-cased, whatever they are."""
    return F.array_join(F.transform(F.slice(tokens(ngram), 1, depth), lambda t: F.left(F.lower(F.left(t, F.lit(1))), F.lit(1))), "")


def first_match(ngrams: DataFrame, prefixes: DataFrame, depth: int = 5, key: Column | None = None) -> DataFrame:
    """Every n-gram with ``bucket``, the first prefix in the order ``ord`` of a list (prefix, ord) that its key begins with; null if none does.

    The list meets n-grams by equality, once for each length of prefix that occurs in it (few), and the smallest ``ord`` wins; where Spark
    can broadcast the list, n-grams aren't shuffled. Prefixes may overlap; they count in lower case, and of equal ones the first. ``key`` is
    ``prefix_key`` of ``depth`` letters, as in histograms, or another column, such as ``initials``.
    """
    rows = _once(ngrams, "_key", prefix_key(tokens(F.col("ngram")), depth) if key is None else key)
    listed = prefixes.groupBy(F.lower("prefix").alias("_begin")).agg(F.min(F.struct("ord", "prefix")).alias("_m"))
    lengths = sorted(r[0] for r in listed.select(F.length("_begin")).distinct().collect())
    for i in lengths:
        own = listed.where(F.length("_begin") == i).select(F.col("_begin").alias(f"_b{i}"), F.col("_m").alias(f"_m{i}"))
        rows = rows.join(own, F.left("_key", F.lit(i)) == F.col(f"_b{i}"), "left")
    found = F.array_min(F.array_compact(F.array(*(f"_m{i}" for i in lengths)))) if lengths else F.lit(None).cast("struct<ord:bigint,prefix:string>")
    return rows.withColumn("bucket", found["prefix"]).drop("_key", *(f"_{c}{i}" for i in lengths for c in "bm"))
