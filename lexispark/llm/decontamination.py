"""Benchmark decontamination: BM25 over test items with block-max WAND, then exact overlap.

The test items are the indexed side, the training texts the queries. An item's retrieval units are the
whole item and its question (of a question of fewer than five words, the answer instead), one for each
way in which the verdict can be reached. A document's query is the set of all its words, so it makes
no difference where in the document, in how many pieces or how far apart an item's words lie.

WAND: units are ordered by threshold and dealt into blocks of ``block`` units. Per term and block the
largest impact is kept, and a block is left for a document when the sum of these over the document's
words can't reach the block's lowest threshold. Only units of the blocks that remain are scored from
their postings. A unit's threshold is its own BM25 score less its heaviest words that may be missing while
80 % of its distinct shingles are there (a missing word takes at least one shingle of its own with it),
so retrieval loses no unit of which a document has 80 % of the shingles.

A retrieved pair is verified on the whole document. The overlap is the share of the item's distinct
five-word shingles in it (fewer words: the whole sequence), question and answer together. The item's
last sentence is taken as its answer and the rest as its question; the overlap of each is returned too
(shingles; the words of an answer of fewer than five). A document holds an item if ``overlap`` is
reached by the whole item, by a question of at least five words, or by an answer of at least five words
whose shorter question is there as a sequence. An answer alone is no hit: it may be common knowledge.

``score`` and ``word_offset`` of a hit are those of the passage (``passage`` words, every ``stride``
words) with the highest BM25 score for any of the item's units, the first one on ties.

Equal item texts are indexed once; their ids are joined to the hits. The index is broadcast only up to
``index_bytes`` of item text; a larger benchmark is dealt into several indexes of that size by hash, and
documents are queried against one after another.

Defined results: null and empty texts match nothing, nor do items without words. Repeated items and
documents each give their rows. An empty benchmark or table gives no rows. Words are compared in
lower case (A-Z). Other columns are ignored or carried.
"""

from __future__ import annotations

import math
import re
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, docs_of, shingles, texts

HIT = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("word_offset", T.LongType()), T.StructField("overlap", T.DoubleType()), T.StructField("question_overlap", T.DoubleType()), T.StructField("answer_overlap", T.DoubleType())])
SHINGLE = 5


class Settings(NamedTuple):
    passage: int = 64
    stride: int = 16
    block: int = 96
    k1: float = 1.2
    b: float = 0.75
    overlap: float = 0.8
    index_bytes: int = 16 << 20


class Item(NamedTuple):
    item_id: int | None
    size: int  # of its shingles in words
    hashes: np.ndarray  # distinct shingles
    question: np.ndarray
    answer: np.ndarray
    answer_words: frozenset
    short: np.ndarray  # the sequence of a question of fewer than five words, or empty
    short_size: int  # its words


class Index(NamedTuple):
    settings: Settings
    terms: dict[bytes, int]
    block_starts: np.ndarray  # of each term's blocks
    blocks: np.ndarray  # block and the largest impact of the term there, by term, then block
    most: np.ndarray
    block_thresholds: np.ndarray
    starts: np.ndarray  # of each term's postings
    units: np.ndarray  # postings: unit and impact, by term, then unit
    impacts: np.ndarray
    thresholds: np.ndarray  # of units, ascending
    owners: np.ndarray  # unit -> item
    items: list[Item]


def _split(text: bytes) -> tuple[list[bytes], int]:
    """Words, and how many of them are the question."""
    words = text.lower().split()
    ends = [m.end() for m in re.finditer(rb"[.!?](?=[\x20\x09-\x0D])|\n", text.strip())]
    cut = len(text.strip()[: ends[-1]].split()) if ends else len(words)
    return words, cut if 0 < cut < len(words) else len(words)


def build(ids: list[int | None], bodies: list[bytes], settings: Settings) -> Index:
    s, hashes, items, units, spare, owners = settings, WordHashes(), [], [], [], []
    for item_id, body in zip(ids, bodies, strict=True):
        words, cut = _split(body)
        if not words:
            continue
        own = lambda w: np.unique(shingles(w, hashes, SHINGLE)) if len(w) >= SHINGLE else np.empty(0, np.uint64)
        short = words[:cut] if cut < SHINGLE and cut < len(words) else []
        x = Item(item_id, min(SHINGLE, len(words)), np.unique(shingles(words, hashes, SHINGLE)), own(words[:cut]), own(words[cut:]), frozenset(words[cut:]), shingles(short, hashes, SHINGLE), len(short))
        items.append(x)
        for unit, whole in ((words, x.hashes), (words[:cut], x.question) if not short else (words[cut:], x.answer)):
            if len(whole) and (unit is words or len(unit) < len(words)):
                units.append(unit)
                spare.append(int((1 - s.overlap) * len(whole) + 1e-9))
                owners.append(len(items) - 1)
    terms: dict[bytes, int] = {}
    rows = []
    for u, words in enumerate(units):
        counts: dict[int, int] = {}
        for w in words:
            t = terms.setdefault(w, len(terms))
            counts[t] = counts.get(t, 0) + 1
        rows += [(t, u, n) for t, n in counts.items()]
    if not rows:
        return Index(s, terms, *(np.zeros(0),) * 9, items)
    t, u, n = np.array(rows, np.int64).T
    df = np.bincount(t).astype(np.float64)
    idf = np.log1p((len(units) - df + 0.5) / (df + 0.5))
    sizes = np.array([len(x) for x in units], np.float64)
    impact = idf[t] * n * (s.k1 + 1) / (n + s.k1 * (1 - s.b + s.b * sizes[u] / sizes.mean()))
    heaviest = np.lexsort((-impact, u))
    edges = np.searchsorted(u[heaviest], np.arange(len(units) + 1))
    thresholds = np.array([impact[heaviest[edges[i] : edges[i + 1]]][missing:].sum() * (1 - 1e-9) for i, missing in enumerate(spare)])
    order = np.argsort(thresholds, kind="stable")
    u = np.argsort(order, kind="stable")[u]
    thresholds, owners = thresholds[order], np.array(owners, np.int64)[order]
    by_term = np.lexsort((u, t))
    t, u, impact = t[by_term], u[by_term], impact[by_term]
    pair, places = np.unique(t * len(units) + u // s.block, return_index=True)
    most = np.maximum.reduceat(impact, places) * (1 + 1e-9)
    ends = np.arange(len(terms) + 1)
    return Index(s, terms, np.searchsorted(pair // len(units), ends), pair % len(units), most, thresholds[:: s.block], np.searchsorted(t, ends), u, impact, thresholds, owners, items)


def _numbers(index: Index, words: list[bytes]) -> np.ndarray:
    """The terms of words; what no item has is one term more."""
    return np.fromiter(map(index.terms.get, words, repeat(len(index.terms))), np.int64, len(words))


def _entries(starts: np.ndarray, query: np.ndarray) -> np.ndarray:
    """The places of all entries of some terms."""
    lo, n = starts[query], starts[query + 1] - starts[query]
    return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def _scores(index: Index, query: np.ndarray, alive: np.ndarray | None = None) -> np.ndarray:
    """BM25 of every unit (of the blocks ``alive``; others 0) for distinct terms."""
    k = _entries(index.starts, query)
    if alive is not None:
        k = k[alive[index.units[k] // index.settings.block]]
    return np.bincount(index.units[k], index.impacts[k], len(index.thresholds))


def retrieve(index: Index, t: np.ndarray) -> list[int]:
    """The items of which a unit reaches its threshold for the terms of a whole document."""
    query = np.unique(t)
    query = query[query < len(index.terms)]
    if not len(query):
        return []
    k = _entries(index.block_starts, query)
    alive = np.bincount(index.blocks[k], index.most[k], len(index.block_thresholds)) >= index.block_thresholds
    if not alive.any():
        return []
    scores = _scores(index, query, None if alive.all() else alive)
    return np.unique(index.owners[(scores >= index.thresholds) & (scores > 0)]).tolist()


def _best_passages(index: Index, t: np.ndarray, items: list[int]) -> dict[int, tuple[float, int]]:
    """item -> (score, word offset) of the passage with the highest score for one of its units."""
    s, found = index.settings, dict.fromkeys(items, (0.0, 0))
    units = np.flatnonzero(np.isin(index.owners, items))
    for at in range(0, max(1, len(t) - s.passage + s.stride), s.stride):
        query = np.unique(t[at : at + s.passage])
        query = query[query < len(index.terms)]
        if len(query):
            scores = _scores(index, query)
            for u in units.tolist():
                item = int(index.owners[u])
                if scores[u] > found[item][0]:
                    found[item] = (float(scores[u]), at)
    return found


def verify(index: Index, words: list[bytes], items: list[int], t: np.ndarray, hashes: WordHashes) -> list[dict]:
    """The hits of a document among retrieved items."""
    by_size: dict[int, np.ndarray] = {}
    least, present, out = index.settings.overlap, frozenset(words), {}

    def share(part: np.ndarray, size: int) -> float:
        if not len(part) or len(words) < size:
            return 0.0
        if size not in by_size:
            by_size[size] = np.unique(shingles(words, hashes, size))
        whole = by_size[size]
        return float((whole[np.minimum(np.searchsorted(whole, part), len(whole) - 1)] == part).mean())

    for item in items:
        x = index.items[item]
        overlap, question, answer = share(x.hashes, x.size), share(x.question, SHINGLE), share(x.answer, SHINGLE)
        if max(overlap, question) >= least or (answer >= least and share(x.short, x.short_size) == 1):
            answer = answer if len(x.answer) else len(x.answer_words & present) / max(1, len(x.answer_words))
            out[item] = {"item_id": x.item_id, "overlap": overlap, "question_overlap": question, "answer_overlap": answer}
    best = _best_passages(index, t, list(out)) if out else {}
    return [x | {"score": best[item][0], "word_offset": best[item][1]} for item, x in out.items()]


def matcher(spark, index: Index):
    """Column -> Column: the verified hits of a text column."""
    held = spark.sparkContext.broadcast(index)

    @F.arrow_udf(T.ArrayType(HIT))
    def hits(text: pa.Array) -> pa.Array:
        own, hashes, out = held.value, WordHashes(), []
        for body in texts(text):
            words = body.lower().split()
            t = _numbers(own, words)
            found = retrieve(own, t)
            out.append(verify(own, words, found, t, hashes) if found else [])
        return pa.array(out, pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("word_offset", pa.int64()), ("overlap", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])))

    return hits


def _texts_of(benchmark: DataFrame) -> DataFrame:
    """item_id, text and a number for each distinct text."""
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_id", F.xxhash64("text"))


def indexes(benchmark: DataFrame, settings: Settings):
    """The indexes of a benchmark's distinct texts, each over at most about ``index_bytes`` of them."""
    items = _texts_of(benchmark).select("text_id", "text").distinct()
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, math.ceil(total / settings.index_bytes))
    for i in range(n):
        own = items if n == 1 else items.where(F.pmod("text_id", F.lit(n)) == i)
        rows = own.toArrow().sort_by([("text_id", "ascending"), ("text", "ascending")])
        index = build(rows["text_id"].to_pylist(), texts(rows["text"].combine_chunks()), settings)
        if index.items:
            yield index


def find(documents: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document and test item that it holds: doc_id and the fields of HIT."""
    spark, docs = documents.sparkSession, docs_of(documents)
    out = spark.createDataFrame([], T.StructType([docs.schema["doc_id"], *HIT.fields]))
    for index in indexes(benchmark, settings):
        hits = matcher(spark, index)
        out = out.union(docs.select("doc_id", F.explode(hits("text")).alias("h")).select("doc_id", "h.*"))
    items = _texts_of(benchmark).select("text_id", F.col("item_id").alias("_item"))
    return out.withColumnRenamed("item_id", "text_id").join(items, "text_id").select("doc_id", F.col("_item").alias("item_id"), *HIT.names[1:])


def filter_documents(documents: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``documents`` that hold no test item, with their columns."""
    for index in indexes(benchmark, settings):
        hits = matcher(documents.sparkSession, index)
        documents = documents.select(F.struct("*").alias("_row"), hits(F.coalesce("text", F.lit(""))).alias("_h")).where(F.size("_h") == 0).select("_row.*")
    return documents
