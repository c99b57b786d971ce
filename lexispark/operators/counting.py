"""Counting the n-grams of documents: Arrow batches are counted in tasks, sums over them are Spark's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that are counted at once, and that a partition of distinct n-grams is made for.
CHUNK, DEALT = 8 << 20, 8 << 20


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of texts as ``functions.tokens.tokens`` has them, and the text of each."""
    for c in "\t\n\r":
        texts = pc.replace_substring(texts, c, " ")
    lists = pc.split_pattern(texts, " ")
    words, place = lists.flatten(), pc.list_parent_indices(lists)
    held = pc.greater(pc.binary_length(words), 0)
    return words.filter(held), place.filter(held).to_numpy()


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``CHUNK`` bytes of text, one row at least."""
    texts = batch.column("texts")
    sizes = pc.fill_null(pc.binary_length(texts.flatten()), 0).to_numpy()
    ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(texts), 0).to_numpy())])]
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def _counts(batch: pa.RecordBatch, keys: list[str], size: int) -> pa.RecordBatch | None:
    """(*keys, ngram, n, d) of a batch (doc_id, *keys, texts): each n-gram of one or two tokens once for equal keys, in order."""
    texts = batch.column("texts")
    words, place = _words(texts.flatten())
    if len(words) < size:
        return None
    doc = pc.list_parent_indices(texts).to_numpy()[place]
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    item = rank[coded.indices.to_numpy()]
    if size == 2:
        near = place[1:] == place[:-1]
        item, doc = (item[:-1] * len(order) + item[1:])[near], doc[1:][near]
        items, item = np.unique(item, return_inverse=True)
    else:
        items = np.arange(len(order))  # every word of the dictionary occurs
    group_of: dict[tuple, int] = {}
    columns = [batch.column(k) for k in keys]
    group = np.array([group_of.setdefault(x, len(group_of)) for x in zip(*(c.to_pylist() for c in columns), strict=True)], np.int64)
    each, n = np.unique(item * batch.num_rows + doc, return_counts=True)  # an item of a document
    own, doc = np.divmod(each, batch.num_rows)
    rows, at = np.unique(own * len(group_of) + group[doc], return_inverse=True)
    own, told = np.divmod(rows, len(group_of))
    known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
    sums = [np.bincount(at, x, len(rows)).astype(np.int64) for x in (n, known[doc])]
    token = lambda i: coded.dictionary.take(pa.array(order[i]))
    picked = items[own]
    ngram = token(picked) if size == 1 else pc.binary_join_element_wise(token(picked // len(order)), token(picked % len(order)), " ")
    first = np.unique(group, return_index=True)[1][told]
    return pa.RecordBatch.from_arrays([*(c.take(pa.array(first)) for c in columns), ngram, *map(pa.array, sums)], [*keys, "ngram", "n", "d"])


def counted(docs: DataFrame, size: int, *keys: str) -> DataFrame:
    """(*keys, ngram, n, d) of documents (doc_id, text, *keys): n-grams of one or two (``size``) neighbouring tokens of a text, how often they
    occur, and in how many documents. A row counts a batch, so rows are still to be summed.

    Nothing is grouped by document. Rows that repeat a doc_id are put together before; to find them only ids are shuffled. A null
    doc_id counts as no document.
    """
    again = F.broadcast(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_k")).where("_k > 1").select("doc_id"))
    docs = docs.where("text is not null").select("doc_id", *keys, "text")
    own = docs.join(again, "doc_id", "left_anti").select("doc_id", *keys, F.array("text").alias("texts"))
    joined = docs.join(again, "doc_id", "left_semi").groupBy("doc_id", *keys).agg(F.collect_list("text").alias("texts"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                if (out := _counts(part, list(keys), size)) is not None and out.num_rows:
                    yield out

    schema = T.StructType([*(docs.schema[k] for k in keys), T.StructField("ngram", T.StringType()), T.StructField("n", T.LongType()), T.StructField("d", T.LongType())])
    return own.union(joined).mapInArrow(count, schema)


def dealt(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``counted`` rows dealt by the n-gram, in as many partitions as the texts of ``docs`` ask for: their size doesn't grow with the corpus."""
    session = docs.sparkSession
    need = -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // DEALT)
    return rows.repartition(need, "ngram") if need > int(session.conf.get("spark.sql.shuffle.partitions")) else rows.repartition("ngram")
