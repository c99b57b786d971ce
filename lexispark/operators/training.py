"""Training per year and parameters.

Dense linear algebra has no DataFrame form, so a year's matrix is worked on in one Arrow group. Its
size follows the distinct words and pairs of a year, not the corpus: training reads co-occurrence
counts that Spark has summed, of words with ``min_count`` or, if asked, the ``vocabulary`` most frequent.
A year of more than ``GROUP`` pairs is trained by blocks (``word2vec``), each in a group of about that size.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.tokens import log_weight, tokens
from ..sources.shared import Steps
from . import word2vec

#: Pairs of a year that one group is trained on.
GROUP = 1 << 21
VECTORS = "year int, word string, vec array<float>"


#: N-grams that a partition of a join with the vocabulary is made for.
ROWS = 1 << 20


def _held(steps: Steps, corpus: DataFrame, weight_by: str, min_count: int, vocabulary: int | None) -> DataFrame:
    """(year, w, t): the tokens of n-grams, null where a word isn't learned in that year; n-grams that leave fewer than two go.

    N-grams are written once, and joined with the words of a year once for each of their few places, whole: no token is a row of its own.
    """
    weight = {"none": F.lit(1), "freq": log_weight(F.col("freq")), "doc_freq": log_weight(F.col("doc"))}[weight_by]
    rows = steps.table(corpus.select("year", weight.cast("double").alias("w"), tokens(F.col("ngram")).alias("t")), "ngrams")
    words = rows.select("year", "w", F.explode("t").alias("word")).groupBy("year", "word").agg(F.sum("w").alias("c")).where(F.col("c") >= min_count)
    if vocabulary is not None:
        words = words.withColumn("r", F.row_number().over(Window.partitionBy("year").orderBy(F.col("c").desc(), "word"))).where(F.col("r") <= vocabulary)
    words = steps.table(words.select("year", "word"), "words")
    longest, n = rows.agg(F.max(F.size("t")), F.count("*")).first()
    own, few = max(-(-n // ROWS), 1), int(steps.spark.conf.get("spark.sql.shuffle.partitions"))
    out = rows.where(F.size("t") > 1)
    for i in range(longest or 0):
        keyed = out.withColumn("_at", F.get("t", F.lit(i)))
        keyed = keyed.repartition(own, "year", "_at") if own > few else keyed
        keyed = keyed.join(words.select("year", F.col("word").alias("_at"), F.lit(True).alias("_in")), ["year", "_at"], "left")
        out = keyed.select("year", "w", F.transform("t", lambda t, k: F.when((k != i) | F.col("_in"), t)).alias("t")).where(F.size(F.array_compact("t")) > 1)
    return out


def cooccurrences(corpus: DataFrame, window: int, weight_by: str = "none", min_count: int = 1, vocabulary: int | None = None) -> DataFrame:
    """(year, word, context, n): weighted pairs within ``window`` positions of n-grams, of each year's words.

    weight_by: none counts an n-gram once, freq and doc_freq by the log weight of its count. The weight
    is multiplied in; no n-gram is replicated. Words rarer than ``min_count`` go before pairs are made;
    ``vocabulary`` keeps only so many of the most frequent, if given. Pairs are as many both ways, so they are
    summed and written one way, and turned when they are read.
    """
    with Steps(corpus.sparkSession, "pairs") as steps:
        each = _held(steps, corpus, weight_by, min_count, vocabulary).select("year", "w", F.posexplode("t").alias("i", "a"), "t").where("a is not null")
        pairs = each.select("year", "w", "a", F.explode(F.slice("t", F.col("i") + 2, window)).alias("b")).where("b is not null")
        pairs = steps.keep(pairs.groupBy("year", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("n")))
    way = lambda a, b, n: F.struct(F.col(a).alias("word"), F.col(b).alias("context"), n.alias("n"))
    once, twice = way("a", "b", F.col("n")), way("b", "a", F.col("n"))
    return pairs.select("year", F.inline(F.when(F.col("a") == F.col("b"), F.array(way("a", "b", 2 * F.col("n")))).otherwise(F.array(once, twice))))


def context_windows(corpus: DataFrame, window: int, weight_by: str = "none", min_count: int = 1, vocabulary: int | None = None) -> DataFrame:
    """(year, word, context, n): as ``cooccurrences``, but with all of a position's context words in one array, in order."""
    places = F.transform(F.sequence(F.lit(-window), F.lit(window)), lambda k: F.when((k != 0) & (F.col("i") + k >= 0), F.get("t", F.col("i") + k)))
    with Steps(corpus.sparkSession, "windows") as steps:
        each = _held(steps, corpus, weight_by, min_count, vocabulary).select("year", "w", F.posexplode("t").alias("i", "word"), "t").where("word is not null")
        whole = each.select("year", "word", "w", F.array_compact(places).alias("context")).where(F.size("context") > 0)
        return steps.keep(whole.groupBy("year", "word", "context").agg(F.sum("w").alias("n")))


def _coded(*texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different texts in order, and the place of each text among them."""
    coded = pa.chunked_array(texts).dictionary_encode().combine_chunks()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy()]


def train(pairs: DataFrame, vector_size: int = 100, approach: str = "CBOW", epochs: int = 5, negative: int = 5, seed: int = 1, rate: float = 0.05) -> DataFrame:
    """Word vectors per year by negative-sampling word2vec (seeded).

    'skip-gram' predicts the context from the word and takes ``cooccurrences``; anything else is CBOW,
    which predicts the word from the mean of its context's vectors and takes ``context_windows`` (or
    pairs, as windows of one word). An epoch draws as many rows as there are, each in proportion to n.
    A year of up to ``GROUP`` rows is one Arrow group. A larger one is trained as ``word2vec.train`` does, by so many blocks that each has about
    ``GROUP`` pairs. CBOW windows of several words can't be dealt into blocks: a year that has any is one group, which must fit a task.
    """
    each = F.size("context") if isinstance(pairs.schema["context"].dataType, T.ArrayType) else F.lit(1)
    sizes = pairs.groupBy("year").agg(F.sum(each if approach == "skip-gram" else F.lit(1)).alias("rows"), F.max(each).alias("widest")).where(F.col("rows") > GROUP).where("year is not null")
    blocks = {r["year"]: int(np.ceil(np.sqrt(r["rows"] / GROUP))) for r in sizes.collect() if approach == "skip-gram" or r["widest"] == 1}
    large = F.coalesce(F.col("year").isin(list(blocks)), F.lit(False))
    dealt = pairs.select("year", "word", F.explode("context").alias("context"), "n") if isinstance(pairs.schema["context"].dataType, T.ArrayType) else pairs
    # Years of like size together: a round is one job.
    by_blocks = [word2vec.train(dealt.where(F.col("year").isin([y for y, k in blocks.items() if k == b])), vector_size, approach, epochs, negative, seed, rate, b) for b in sorted(set(blocks.values()))]
    pairs = pairs.where(~large) if blocks else pairs

    def fit(table: pa.Table) -> pa.Table:
        rng = np.random.default_rng(seed)
        word, context, n = (table.column(c).combine_chunks() for c in ("word", "context", "n"))
        lists = context if pa.types.is_list(context.type) else pa.ListArray.from_arrays(pa.array(np.arange(len(context) + 1, dtype=np.int32)), context)
        vocab, code = _coded(word, lists.flatten())
        word, told, sizes, n = code[: len(word)], code[len(word) :], pc.list_value_length(lists).to_numpy(), n.to_numpy().astype(np.float64)
        # Contexts as rows of equal length; what is beyond a row's own length weighs nothing, and is less than any word in their order.
        held = np.arange(sizes.max())[None, :] < sizes[:, None]
        context = np.full(held.shape, -1, np.int32)
        context[held] = told
        order = np.lexsort([*context.T[::-1], word])
        word, n, sizes, held = word[order], n[order], sizes[order], held[order]
        context = np.where(held, context[order], 0)
        share = np.where(held, 1 / sizes[:, None], 0)
        given, part, told = context, share, word
        if approach == "skip-gram":
            given, part, told, n = np.repeat(word, sizes)[:, None], np.ones((sizes.sum(), 1)), context[held], np.repeat(n, sizes)
        freq = np.bincount(told, n, len(vocab)) ** 0.75
        cdf, drawn = np.cumsum(freq) / freq.sum(), np.cumsum(n) / n.sum()
        x, y = (rng.random((len(vocab), vector_size)) - 0.5) / vector_size, np.zeros((len(vocab), vector_size))
        for epoch in range(epochs):
            step = rate * (1 - epoch / epochs)
            rows = np.searchsorted(drawn, rng.random(len(told))).clip(0, len(told) - 1)
            for i in range(0, len(rows), 512):
                k = rows[i : i + 512]
                hidden = np.einsum("bc,bcd->bd", part[k], x[given[k]])
                targets = np.concatenate([told[k][:, None], np.searchsorted(cdf, rng.random((len(k), negative))).clip(0, len(vocab) - 1)], axis=1)
                label = np.zeros(targets.shape)
                label[:, 0] = 1
                err = (label - 1 / (1 + np.exp(-np.einsum("bd,btd->bt", hidden, y[targets]).clip(-30, 30)))) * step
                back = np.einsum("bt,btd->bd", err, y[targets])
                word2vec.add_rows(y, targets, err[:, :, None] * hidden[:, None, :])
                word2vec.add_rows(x, given[k], part[k][:, :, None] * back[:, None, :])
        vec = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, vector_size, dtype=np.int32)), pa.array(x.astype(np.float32).reshape(-1)))
        return pa.table({"year": pa.repeat(table.column("year")[0], len(vocab)).cast(pa.int32()), "word": vocab, "vec": vec})

    return functools.reduce(DataFrame.union, by_blocks, pairs.groupBy("year").applyInArrow(fit, VECTORS))


def parameter_grid(spark, **axes) -> DataFrame:
    """Every combination of parameters: one column per axis; axes are short lists."""
    out = spark.range(1, numPartitions=1)
    for name, values in axes.items():
        own = values if isinstance(values, (list, tuple)) else [values]
        # Literals in one row: joining a table per axis would multiply their partitions.
        out = out.select("*", F.explode(F.array(*(F.lit(v).cast("long") if type(v) is int else F.lit(v) for v in own))).alias(name))
    return out.drop("id") if "id" not in axes else out


#: How a model's name tells its parameters.
MODEL_NAME = r"w2v_y(\d{4})_wb(\w+)_vs(\d+)_w(\d+)_mc(\d+)_sg(\d)_e(\d+)"


def model_name(year, weight_by, vector_size, window, min_count, sg, epochs):
    """Column of model names that ``parse_model_name`` reads."""
    return F.concat_ws("", F.lit("w2v_y"), year, F.lit("_wb"), weight_by, F.lit("_vs"), vector_size, F.lit("_w"), window, F.lit("_mc"), min_count, F.lit("_sg"), sg, F.lit("_e"), epochs, F.lit(".kv"))


def parse_model_name(models: DataFrame, column: str = "model") -> DataFrame:
    """year, weight_by, vector_size, window, min_count, approach and epochs of model names."""
    part = lambda i: F.nullif(F.regexp_extract(column, MODEL_NAME, i), F.lit(""))
    return models.select(column, part(1).cast("int").alias("year"), part(2).alias("weight_by"), part(3).cast("int").alias("vector_size"), part(4).cast("int").alias("window"), part(5).cast("int").alias("min_count"), F.when(part(6) == "1", "skip-gram").when(part(6).isNotNull(), "CBOW").alias("approach"), part(7).cast("int").alias("epochs"))
