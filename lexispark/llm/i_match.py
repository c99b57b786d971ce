"""Document fingerprints by I-Match over several randomised lexicons, with DataFrame functions only.

A term is a lower-cased word, held as its 64-bit hash. The lexicon is the terms whose inverse document
frequency, log(N / df) / log(N), lies within ``band``: stop words and one-off spellings tell nothing about
a text. It is dealt at random into ``GROUPS`` lexicons by hash. A text's signature in each is the
hash of its distinct terms there, in order; the fingerprint is all signatures, eight hex digits each, dots where a
text has no term. Two fingerprints are alike by the share of equal signatures among those that either has.

One changed term changes the signature of its group, so a text of many terms is thinned first: of n distinct terms
those remain whose hash falls below a threshold that halves each time n doubles, at another n in each group.
Between ``terms`` and twice as many stay of any long text, and near copies keep the same ones. Whether a term stays
doesn't depend on df, so what is shuffled is a bounded number of terms per text, while df counts all texts and terms.

Defined results: null and empty texts, and those of white space, have no term: their fingerprint is all dots,
like each other (1.0) and like nothing else (0.0). Where no remaining term of a text is in the lexicon, all
its remaining terms are taken. Equal texts have equal fingerprints, whatever their row. In the order of documents a null doc_id comes first, rows of
one doc_id go by the hash of their text, and equal rows follow one another. A single row is its own next one. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WHITESPACE, Scratch

#: The lexicons are told apart by the lowest five bits of a term's hash; the next 40 decide how it is thinned.
GROUPS, _BITS, _PLACES = 32, 5, 40
_NONE = "." * 8
_LOWEST = -(1 << 63)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def words(text: Column) -> Column:
    """The distinct terms of a text, as hashes."""
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(text), WHITESPACE), lambda w: w != ""), lambda w: F.xxhash64(w)))


def _thinned(terms: Column, least: int) -> Column:
    def kept(own: Column) -> Column:
        doubled = F.log2(F.greatest(F.size(own), F.lit(1)) / F.lit(float(least)))

        def stays(h: Column) -> Column:
            halvings = F.greatest(F.lit(0), F.floor(doubled + h.bitwiseAND(GROUPS - 1) / float(GROUPS)))
            return F.shiftrightunsigned(h, _BITS).bitwiseAND((1 << _PLACES) - 1) < F.pow(F.lit(2.0), F.lit(_PLACES) - halvings)

        return F.filter(own, stays)

    return _let(terms, kept)


def _longs(values: list[int]) -> Column:
    """A constant array, folded once by the optimiser however long it is."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _bounds(rows: DataFrame, per_bucket: int, most: int, per_bound: int) -> list[tuple[int, int]]:
    """The first (key, hash) of each bucket in order; each is a row's own, so no bucket is empty.

    They come from a sample of some ``per_bound`` rows a bucket, at most ``most`` buckets, so what reaches the driver is
    bounded. A key with the rows of more than two buckets is cut further by the hashes of a sample of its texts.
    """
    n, low = rows.agg(F.count("*"), F.min("key")).first()
    if not n:
        return []
    buckets = max(1, min(most, n // per_bucket))
    rate = per_bound * buckets / n
    drawn = rows.where(F.rand(7) < rate).groupBy("key").agg(F.count("*").alias("n"))
    sample = sorted((r["key"], r["n"]) for r in drawn.collect())
    step = max(1.0, sum(m for _, m in sample) / buckets)
    out, hot, seen, goal = {(low, _LOWEST)}, [], 0, step
    for key, m in sample:
        if seen >= goal or m >= 2 * step:
            out.add((key, _LOWEST))
            goal = seen + step
        if m >= max(8, 2 * step):
            hot.append(key)
            goal = 0  # the next key begins a bucket
        seen += m
    if hot:
        held = rows.where(F.col("key").isin(hot)).select("key", F.xxhash64("text").alias("h"))
        cuts = {(r["key"], r["h"]) for r in held.groupBy("key").agg(F.min("h").alias("h")).collect()}
        drawn = sorted(tuple(r) for r in held.where(F.rand(7) < rate).collect())
        out = {x for x in out if x[0] not in hot} | cuts | set(drawn[:: math.ceil(step)])
    return sorted(out)


def with_next(documents: DataFrame, per_bucket: int = 512, most: int = 16_384, per_bound: int = 16) -> DataFrame:
    """doc_id, text and next_text of every row, with its number ``rid`` and that of the next row, ``next_rid``.

    Texts move once: to the bucket of their doc_id, where a window looks one row ahead. The first row of each bucket goes to
    the bucket before as well, and the very first one to the last bucket, so nothing is looked up across buckets.
    """
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("key"))
    bounds = _bounds(rows, per_bucket, most, per_bound)
    if not bounds:
        none = F.lit(None).cast("long")
        return rows.select("doc_id", "text", F.col("text").alias("next_text"), none.alias("rid"), none.alias("next_rid"))
    keys, hashes, n = _longs([k for k, _ in bounds]), _longs([h for _, h in bounds]), len(bounds)
    rows = rows.withColumn("h", F.xxhash64("text"))

    def further(at: Column, by: Column) -> Column:
        key, h = F.get(keys, at + by - 1), F.get(hashes, at + by - 1)
        return F.when((key < F.col("key")) | ((key == F.col("key")) & (h <= F.col("h"))), at + by).otherwise(at)

    halves = F.array(*(F.lit(1 << i) for i in reversed(range(n.bit_length()))))
    rows = rows.withColumn("bucket", F.aggregate(halves, F.lit(0), further))
    at = F.col("bucket") - 1
    first = (F.get(keys, at) == F.col("key")) & F.get(hashes, at).isin(F.lit(_LOWEST), F.col("h"))
    place = lambda bucket, ahead: F.struct(bucket.cast("int").alias("bucket"), F.lit(ahead).alias("ahead"))
    before = F.when(F.col("bucket") == 1, place(F.lit(n), 2)).otherwise(place(at, 1))
    placed = rows.select("doc_id", "text", "key", "h", F.explode(F.when(first, F.array(place(F.col("bucket"), 0), before)).otherwise(F.array(place(F.col("bucket"), 0)))).alias("p"))
    w = Window.partitionBy("p.bucket").orderBy("p.ahead", "key", "h")
    rid = lambda bucket, r: bucket.cast("long") * (1 << 40) + r
    out = placed.select("doc_id", "text", "p.*", F.lead("text").over(w).alias("next_text"), F.lead("p.ahead").over(w).alias("then"), F.row_number().over(w).alias("r"))
    follows = F.when(F.col("then") == 0, rid(F.col("bucket"), F.col("r") + 1)).when(F.col("then") == 1, rid(F.col("bucket") + 1, F.lit(1))).otherwise(rid(F.lit(1), F.lit(1)))
    return out.where("ahead = 0").select("doc_id", "text", "next_text", rid(F.col("bucket"), F.col("r")).alias("rid"), follows.alias("next_rid"))


def edited(text: Column, next_text: Column) -> Column:
    """The last quarter of the code points replaced by as many first ones of the next text."""
    n = F.char_length(text)
    q = F.floor(n / 4).cast("int")
    return F.concat(F.left(text, n - q), F.left(next_text, q))


def lexicon(documents: DataFrame, band: tuple[float, float]) -> DataFrame:
    """(h) of the terms within the band, counted over all documents; a term counts once a document."""
    n = documents.count()
    df = documents.select(F.explode(words(F.coalesce("text", F.lit("")))).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(float(n)) / F.col("df")) / F.log(F.lit(float(max(n, 2))))
    return df.where(idf.between(*band)).select("h")


def _signatures(own: str) -> Column:
    """The signatures of the terms in column ``own`` (struct: h, known); without a known one all terms count."""
    known = F.filter(own, lambda t: t["known"])
    hashes = F.array_sort(F.transform(F.when(F.size(known) > 0, known).otherwise(F.col(own)), lambda t: t["h"]))

    def signature(g: Column, all_: Column) -> Column:
        return _let(F.filter(all_, lambda h: h.bitwiseAND(GROUPS - 1) == g), lambda a: F.when(F.size(a) > 0, F.right(F.concat(F.lit("0" * 8), F.lower(F.hex(F.xxhash64(a)))), F.lit(8))).otherwise(F.lit(_NONE)))

    return _let(hashes, lambda all_: F.transform(F.sequence(F.lit(0).cast("long"), F.lit(GROUPS - 1).cast("long")), lambda g: signature(g, all_)))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal signatures among those that either of two fingerprints (arrays) has; 1 if neither has any."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    used = lambda c: F.size(F.filter(c, lambda p: (p["x"] != _NONE) | (p["y"] != _NONE)))
    same = lambda c: F.size(F.filter(c, lambda p: (p["x"] == p["y"]) & (p["x"] != _NONE)))
    return F.when(used(pairs) == 0, 1.0).otherwise(same(pairs) / used(pairs))


def fingerprints(documents: DataFrame, band: tuple[float, float] = (0.2, 0.9), terms: int = 32) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row."""
    with Scratch(documents.sparkSession, "imatch") as scratch:
        known = scratch.table(lexicon(documents, band), "lexicon", "none")
        rows = with_next(documents).withColumn("after", edited(F.col("text"), F.col("next_text")))
        rows = rows.select("doc_id", "rid", "next_rid", F.char_length("text").cast("long").alias("n_chars"), F.unhex(F.sha2("after", 256)).alias("sha"), F.struct(_thinned(words(F.col("text")), terms).alias("o"), _thinned(words(F.col("after")), terms).alias("e")).alias("t"))
        # Each term once, with where it stands: 0 in both texts, 1 in the text, 2 in the edited one.
        sides = [F.array_intersect("t.o", "t.e"), F.array_except("t.o", "t.e"), F.array_except("t.e", "t.o")]
        rows = scratch.table(rows.select("doc_id", "rid", "next_rid", "n_chars", "sha", *(s.alias(f"s{i}") for i, s in enumerate(sides))), "terms")
        side = lambda i: F.transform(f"s{i}", lambda h: F.struct(h.alias("h"), F.lit(i).cast("byte").alias("side")))
        each = rows.select("rid", F.explode(F.concat(side(0), side(1), side(2))).alias("t")).select("rid", "t.*")
        each = each.join(known.select("h", F.lit(True).alias("known")), "h", "left").select("rid", F.struct("h", F.coalesce("known", F.lit(False)).alias("known"), "side").alias("t"))
        # A text has at most some 2 * terms of these, by the thinning.
        held = each.groupBy("rid").agg(F.collect_list("t").alias("t"))
        none = F.array().cast("array<struct<h:bigint,known:boolean,side:tinyint>>")
        own = rows.select("rid", "next_rid", "doc_id", "n_chars", "sha").join(held, "rid", "left").withColumn("t", F.coalesce("t", none))
        own = own.withColumns({"o": F.filter("t", lambda x: x["side"] < 2), "e": F.filter("t", lambda x: x["side"] != 1)})
        own = scratch.table(own.select("rid", "next_rid", "doc_id", "n_chars", "sha", _signatures("o").alias("o"), _signatures("e").alias("e")), "signatures")
        follows = own.select(F.col("rid").alias("next_rid"), F.col("o").alias("x"))
        out = own.join(follows, "next_rid").select("doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), F.array_join("o", "").alias("fingerprint"), F.array_join("e", "").alias("edited_fingerprint"), likeness(F.col("o"), F.col("e")).alias("near_edited"), likeness(F.col("o"), F.col("x")).alias("near_next"))
        return scratch.keep(out)
