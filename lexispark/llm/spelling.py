"""Spelling variants: words at edit distance one, by a self-join of vocabulary tries with active-node sets.

Two words one edit apart share the first half of the shorter one, or else its last half. So each word goes to the
tries of the words that begin like it, and, read backwards, to the tries of those that end like it: three partitions a word
in all, each a subtrie below a prefix of two letters or more. In a partition the trie is walked from its root; every node
carries its active nodes, those at distance exactly one that come before it. A child inherits the active nodes' children
by the same letter (the edit is spent), and gains its siblings that come first (a letter replaced) and its parent
(a letter inserted). Where a node and an active node both end a word, the pair is emitted, if the partition is that of half of
the shorter word. A pair that shares its first half is left to the forward tries, so none comes twice.

Words are counted in one pass: each text's runs of letters are counted, spoiled where the checksum says so, and summed per
task before they are shuffled. A word's form is its most frequent near word if that is at least ``ratio`` times as
frequent; forms lead to ever more frequent words, so roots are found by doubling the paths, in about
log2(log2(largest count)) rounds.

Defined results: null texts have no words; a null doc_id counts as the empty text in the checksum; rows that repeat a
doc_id count again. Words of equal count go by code points. Without words the result is empty. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, docs_of

LETTERS = "A-Za-zÀ-ÿ"


def _run(least: int):
    """Maximal runs of letters, after A-Z are lower-cased, that are long enough to be words."""
    return re.compile(rf"[a-zÀ-ÿ]{{{least},}}").findall


def spoiled(run: str, base: int, every: int) -> str:
    """The run, without one letter if ``every`` divides the checksum of ``<doc_id>:<run>``; ``base`` is that of what stands before."""
    h = zlib.crc32(run.encode(), base)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def counts(documents: DataFrame, least: int = 5, every: int = 97, most: int = 400_000) -> DataFrame:
    """(word, n) of all words of ``least`` letters; a task holds at most ``most`` words before it passes their sums on."""
    runs = _run(least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in Counter(runs(text.encode().lower().decode())).items():
                    word = spoiled(run, base, every)
                    if len(word) >= least:
                        held[word] += n
                if len(held) >= most:
                    yield _batch(held)
                    held = Counter()
        yield _batch(held)

    each = docs_of(documents).select(F.col("doc_id").cast("string"), "text").mapInArrow(count, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n"))


def _batch(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])


def halves(word: Column) -> Column:
    """Array of (back, at): partitions of a word are its first ``at`` letters, and backwards its last ``at`` ones."""
    n = F.char_length(word)
    at = lambda x: F.floor(x / 2).cast("int")
    ways = [F.struct(F.lit(back).alias("back"), at(x).alias("at")) for back, x in ((False, n), (False, n - 1), (True, n), (True, n + 1))]
    return F.array_distinct(F.array(*ways))


class Trie:
    """Nodes are numbers; the words of a partition, each without the letters that all share."""

    def __init__(self, words: list[str]):
        self.kids: list[dict[str, int]] = [{}]
        self.word = [-1]
        for i, w in enumerate(words):
            at = 0
            for c in w:
                kids = self.kids[at]
                if c not in kids:
                    kids[c] = len(self.kids)
                    self.kids.append({})
                    self.word.append(-1)
                at = kids[c]
            self.word[at] = i

    def pairs(self) -> Iterator[tuple[int, int]]:
        """(i, j) of words at distance one, each pair once."""
        walk: list[tuple[int, list[int]]] = [(0, [])]
        while walk:
            at, active = walk.pop()
            if self.word[at] >= 0:
                for a in active:
                    if self.word[a] >= 0:
                        yield self.word[at], self.word[a]
            before: list[int] = []
            for c, kid in self.kids[at].items():
                near = {self.kids[a][c] for a in active if c in self.kids[a]}
                near.update(before)
                near.add(at)
                if self.kids[kid] or self.word[kid] >= 0:
                    walk.append((kid, list(near)))
                before.append(kid)


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b) of words (word, n) at distance exactly one, each pair once."""
    each = vocabulary.select("word", "n", F.explode(halves(F.col("word"))).alias("p"))
    each = each.select("p.back", F.when(F.col("p.back"), F.reverse("word")).otherwise(F.col("word")).alias("path"), "p.at", "n")
    each = each.select("back", F.left("path", F.col("at")).alias("prefix"), F.substr("path", F.col("at") + 1).alias("rest"), "n")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rest, n, out = None, [], [], []
        for batch in batches:
            for back, prefix, tail, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (back, prefix) != key:
                    out += _of(key, rest, n)
                    key, rest, n = (back, prefix), [], []
                    if len(out) >= 10_000:
                        yield _pairs(out)
                        out = []
                rest.append(tail)
                n.append(m)
        out += _of(key, rest, n)
        yield _pairs(out)

    dealt = each.repartition("back", "prefix").sortWithinPartitions("back", "prefix", "rest")
    return dealt.mapInArrow(join, "a string, n_a long, b string, n_b long")


def _of(key: tuple[bool, str] | None, rest: list[str], n: list[int]) -> list[tuple]:
    if len(rest) < 2:
        return []
    (back, prefix), out = key, []
    for i, j in Trie(rest).pairs():
        a, b = prefix + rest[i], prefix + rest[j]
        shorter = min(len(a), len(b))
        half = shorter // 2
        if len(prefix) != (shorter - half if back else half):
            continue
        if back:
            a, b = a[::-1], b[::-1]
            if a[:half] == b[:half]:
                continue
        out.append((a, n[i], b, n[j]))
    return out


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64()) * 2, strict=True)], ["a", "n_a", "b", "n_b"])


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of every word with a form: paths are doubled until none grows."""
    now, i = scratch.table(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("grew")), "roots_0"), 0
    while now.where("grew").limit(1).count():
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = scratch.table(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("grew")), f"roots_{i + 1}")
        scratch.drop(f"roots_{i}")
        i += 1
    return now.select("word", "root")


def variants(documents: DataFrame, least: int = 5, occurrences: int = 3, ratio: int = 2, every: int = 97) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``least`` letters with ``occurrences``."""
    with Scratch(documents.sparkSession, "spelling") as scratch:
        words = scratch.table(counts(documents, least, every).where(F.col("n") >= occurrences), "words")
        pairs = scratch.table(near_pairs(words), "pairs")
        both = pairs.union(pairs.select("b", "n_b", "a", "n_a"))
        # The largest count, then the first word: the smallest of (-n, word).
        near = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("n"), F.col("b").alias("form"))).alias("best"))
        near = scratch.table(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.n") >= ratio * F.col("n"), F.col("best")).alias("best")), "near")
        forms = near.where("best is not null").select("word", "best.form")
        out = near.join(roots(forms, scratch), "word", "left")
        return scratch.keep(out.select("word", F.col("best.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", (-F.col("best.n")).alias("form_n")))
