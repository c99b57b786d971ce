"""Recursive prefix partition and first-match join against plain recursion."""

import collections
import json
import random

import pytest
from pyspark.sql import functions as F

from lexispark.operators import buckets
from lexispark.sources import text


def plain_partition(hist, n, max_depth):
    deepest = max(map(len, hist))

    def total(p):
        return sum(m for k, m in hist.items() if k.startswith(p))

    def cut(p, target):
        kids = sorted({k[: len(p) + 1] for k in hist if k.startswith(p) and len(k) > len(p)})
        if len(p) >= max_depth or total(p) <= target or all(len(k) == deepest for k in kids):
            return [(p, total(p))]
        return [x for k in kids for x in cut(k, target)]

    target = sum(hist.values()) / n
    out = cut("", target)
    for _ in range(5):
        if len(out) == n:
            break
        target *= 1.1 if len(out) > n else 0.9
        out = cut("", target)
    return sorted(out)


@pytest.mark.parametrize("seed, depth, n, max_depth", [(1, 5, 20, 3), (2, 3, 7, 5), (3, 2, 5, 1), (4, 1, 4, 3), (5, 4, 200, 2), (6, 5, 1, 3)])
def test_partition_equals_recursion(spark, seed, depth, n, max_depth):
    rng = random.Random(seed)
    hist = collections.Counter("".join(rng.choice("aaaabbcde_"[: rng.choice([5, 10])]) for _ in range(depth)) for _ in range(3000))
    df = spark.createDataFrame(list(hist.items()), "prefix string, total long")
    got = buckets.partition(df, n, max_depth).orderBy("ord").collect()
    assert [(r["prefix"], r["total"]) for r in got] == plain_partition(hist, n, max_depth)
    assert [r["ord"] for r in got] == list(range(len(got)))
    assert sum(r["total"] for r in got) == 3000


def test_no_histogram(spark):
    assert buckets.partition(spark.createDataFrame([], "prefix string, total long")).count() == 0


def test_first_match_in_list_order(spark):
    ngrams = ["Apple bat cat", "apple zoo", "bat", "Ärger ant", "1 2 3", "", "  bat  cat ", "apple bat zoo"]
    prefixes = ["abc", "a", "ab", "B", "abz", "b"]
    rows = spark.createDataFrame([(g, i) for i, g in enumerate(ngrams)] + [("bat", 9)], "ngram string, i int")
    listed = spark.createDataFrame(list(enumerate(prefixes)), "ord long, prefix string")
    got = {r["i"]: r["bucket"] for r in buckets.first_match(rows, listed).collect()}
    assert got == {0: "abc", 1: "a", 2: "B", 3: None, 4: None, 5: None, 6: "B", 7: "a", 9: "B"}
    raw = {r["i"]: r["bucket"] for r in buckets.first_match(rows, spark.createDataFrame([(0, "äa"), (1, "1"), (2, "")], "ord long, prefix string"), key=buckets.initials(F.col("ngram"))).collect()}
    assert raw[3] == "äa" and raw[4] == "1" and raw[5] == "" and raw[0] == ""
    assert buckets.first_match(rows, listed.limit(0)).where("bucket is not null").count() == 0


def test_every_key_has_one_bucket(spark):
    rng = random.Random(8)
    rows = spark.createDataFrame([(" ".join(rng.choice(["ant", "bee", "Cat", "9", "dog"]) for _ in range(3)),) for _ in range(500)], "ngram string")
    from lexispark.operators import order

    cut = buckets.partition(order.prefix_histogram(rows, 5), 6, 3)
    got = buckets.first_match(rows, cut).groupBy("bucket").count()
    assert {(r[0], r[1]) for r in got.collect()} == {(r["prefix"], r["total"]) for r in cut.collect()}


def test_lists_as_json(spark, tmp_path):
    listed = spark.createDataFrame([("b", 3, 1), ('a"', 12, 0), ("", 1, 2)], "prefix string, total long, ord long")
    text.write_bucket_list(listed, str(tmp_path / "b"))
    (file,) = (tmp_path / "b").glob("part*")
    assert json.loads(file.read_text()) == [['a"', 12], ["b", 3], ["", 1]]
    assert sorted(map(tuple, text.read_bucket_list(spark, str(tmp_path / "b")).collect())) == sorted([('a"', 12, 0), ("b", 3, 1), ("", 1, 2)])
    (tmp_path / "c.json").write_text(json.dumps(["x", "", ["y", 5]], indent=2))
    assert sorted(map(tuple, text.read_bucket_list(spark, str(tmp_path / "c.json")).collect()), key=lambda r: r[2]) == [("x", None, 0), ("", None, 1), ("y", 5, 2)]
