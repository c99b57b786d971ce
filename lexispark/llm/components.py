"""Connected components of an edge table, by rounds of large-star and small-star.

Each round's edges are written to the shared folder; nothing but two totals per round reaches the
driver. A hub is never gathered in one group: its smallest neighbour is a partial aggregate, and the
join that hands it out can be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(edges: DataFrame) -> DataFrame:
    """(a, b), a > b, after a large star and a small star."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.greatest("b", "m").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    return small.where("a <> b").distinct()


def _edges(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def labels(edges: DataFrame, scratch: Scratch, name: str, rounds: int = 2) -> DataFrame:
    """(id, root) of nodes with an edge (a, b) after a few rounds: nodes of one root are connected, though not all that are need have one root yet.

    A node without a row is its own root. Each round is written: a star reads its edges eight times, so a plan of two rounds reads them 64 times, and
    the driver plans that anew, and keeps what it planned, at each of its shuffles.
    """
    now = scratch.gathered(_edges(edges), f"{name}_0")
    for i in range(1, rounds + 1):
        now = scratch.gathered(_star(now), f"{name}_{i}")
        scratch.drop(f"{name}_{i - 1}")
    return now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root"))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, root) of every node with an edge (a, b): root is the smallest id of its component."""
    now = scratch.gathered(_edges(edges), f"{name}_0")
    seen, i = None, 0
    while True:
        total = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if total == seen or not total[0]:
            break
        seen, i = total, i + 1
        now = scratch.gathered(_star(now), f"{name}_{i}")
        scratch.drop(f"{name}_{i - 1}")
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).union(roots)
