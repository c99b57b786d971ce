"""Quality rules whose cutoffs are certified on labelled documents.

Every document gets the counts below from its whole text. A rule rejects a document when one ratio
of these counts lies above a cutoff. The distinct texts of a stratum (``lang``) that are labelled and pass the
base rule are split by a hash of the text, so copies of a text count once and never lie in both halves. On the first half each rule gets the cutoff of the best balance (share of bad
documents rejected, less ten times the share of clean ones; the loosest on ties), and rules are put in
the order of that balance; a rule without a positive one takes no part. The second half tests the rules
one after another, each together with all before it: an exact binomial test must show that they reject
at most a share ``alpha`` of the clean texts of the stratum, and the first that fails and all after
it are dropped. As the order is fixed before the second half is looked at, the tests of a stratum need no
correction among themselves (fixed-sequence testing); the level is ``delta`` divided by the number of
strata (Bonferroni). So with confidence 1 - delta, in no stratum are more than ``alpha`` of the clean
texts rejected by rules. Texts that differ, if only by a letter, count as independent.

Defined results: a null or empty text has no words, so it fails the base rule (n_words < 50). A
null lang is a stratum of its own. Without labels nothing is certified and only the base rule
rejects; a stratum whose second half has no clean document rejected needs log(level) / log(1 - alpha)
clean ones there to certify (86 with four strata). Documents, and texts, whose labels contradict each other
are left out of the calibration. Other columns of the
input are ignored by ``measure`` and carried by ``filter_documents``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, texts

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
METRICS = T.StructType([T.StructField(c, T.LongType(), False) for c in COUNTS])

#: Ratio that a rule looks at, and the cutoffs tried, loosest first. Parameters of this library.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / n_words", (2.0, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.34, 0.3, 0.2)),
    "repeats": ("n_repeat_words / n_words", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "upper": ("n_upper / greatest(word_chars, 1)", (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1)),
    "word_length": ("word_chars / n_words", (40.0, 30.0, 25.0, 20.0, 15.0, 12.0, 10.0)),
}

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def count(text: bytes) -> tuple[int, ...]:
    """COUNTS of one text."""
    words = text.split()
    n = len(words)
    if not n:
        raw = np.frombuffer(text, np.uint8)
        return (0, 0, int(_SYMBOL[raw].sum()), 0, 0, 0, 0)
    raw = np.frombuffer(text, np.uint8)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    repeat = 0
    if n >= 3:
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
        _, pair = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)
        _, window, times = np.unique(pair[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
        again = times[window] >= 2
        covered = np.zeros(n, bool)
        for i in range(3):
            covered[i : n - 2 + i] |= again
        repeat = int(covered.sum())
    return (
        n,
        int((((raw & 0xC0) != 0x80) & ~_SPACE[raw]).sum()),
        int(_SYMBOL[raw].sum()),
        len(lines) - len(set(lines)),
        repeat,
        len(lines),
        int(((raw >= 65) & (raw <= 90)).sum()),
    )


@F.arrow_udf(METRICS)
def metrics(text: pa.Array) -> pa.Array:
    rows = [count(x) for x in texts(text)]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COUNTS))], list(COUNTS))


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def measure(documents: DataFrame) -> DataFrame:
    """doc_id, lang, a hash of the text and COUNTS of every row."""
    text = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", "lang", F.xxhash64(text).alias("text_hash"), metrics(text).alias("m")).select("doc_id", "lang", "text_hash", "m.*")


def binomial_tail(k: int, n: int, rate: float) -> float:
    """P(X <= k) for X ~ Binomial(n, rate): the p-value of "the true rate is at least ``rate``"."""
    if n <= 0:
        return 1.0
    i = np.arange(1, k + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log((n - i + 1) / i) + math.log(rate / (1 - rate)))]) + n * math.log1p(-rate)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def _hit(rule: str, cutoff: str) -> str:
    return f"coalesce(({RULES[rule][0]}) > {cutoff}, false)"


def choose(row: dict) -> dict:
    """Of a stratum, each rule's cutoff of the best balance and its place among the rules, from sums of rejections."""
    clean, bad, best = row["clean"], row["labelled"] - row["clean"], {}
    for at, (rule, (_, cutoffs)) in enumerate(RULES.items()):
        for i, c in enumerate(cutoffs):
            gain = row[f"{rule}_{i}_0"] / max(bad, 1) - 10 * row[f"{rule}_{i}_1"] / max(clean, 1)
            if gain > best.get(rule, (0.0,))[0]:
                best[rule] = (gain, -at, c)
    order = sorted(best, key=lambda r: best[r][:2], reverse=True)
    return {"lang": row["lang"]} | {f"cut_{r}": best[r][2] for r in order} | {f"place_{r}": i + 1 for i, r in enumerate(order)}


def _each(f, schema: T.StructType):
    """A function of rows as one of batches; a missing column is null. There is one row per stratum."""
    kinds = pa.schema([(x.name, pa.string() if x.name == "lang" else pa.int64() if isinstance(x.dataType, T.LongType) else pa.float64()) for x in schema])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([{n: None for n in schema.names} | f(row) for row in batch.to_pylist()], kinds)

    return run


def certify(row: dict, alpha: float, level: float) -> tuple[int, list[float]]:
    """How many of the rules in order stay, and the p-value of each with all before it."""
    ps = [binomial_tail(int(row[f"step_{i}"] or 0), int(row["clean"] or 0), alpha) for i in range(1, len(RULES) + 1)]
    return next((i for i, p in enumerate(ps) if not p <= level), len(ps)), ps


PICKED = T.StructType([T.StructField("lang", T.StringType()), *(T.StructField(f"cut_{r}", T.DoubleType()) for r in RULES), *(T.StructField(f"place_{r}", T.LongType()) for r in RULES)])
CERTIFIED = T.StructType([T.StructField("lang", T.StringType()), *(T.StructField(f"cut_{r}", T.DoubleType()) for r in RULES), *(T.StructField(f"bound_{r}", T.DoubleType()) for r in RULES)])


def calibrate(measured: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """One row per stratum (lang): the certified cutoff of each rule (null: none) and the p-value it was tested with.

    ``measured`` is what ``measure`` returns. Copies of a text are folded first. Counts of rejections are sums made
    in two aggregations, one per half; only they, never documents, reach a task that chooses and tests.
    """
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
    marks = marks.where("lo = hi").select("doc_id", F.col("lo").alias("_q"))
    held = measured.where(~base_failed()).join(marks, "doc_id").groupBy("lang", "text_hash", *COUNTS).agg(F.min("_q").alias("_q"), F.max("_q").alias("_hi"))
    held = held.where("_q = _hi").withColumn("_second", F.pmod("text_hash", F.lit(2)) == 1)
    sums = [F.sum(F.col("_q").cast("long")).alias("clean"), F.count("*").alias("labelled")]
    for rule, (_, cutoffs) in RULES.items():
        for i, c in enumerate(cutoffs):
            sums += [F.sum(F.when(F.expr(_hit(rule, f"{c}D")) & (F.col("_q") == q), 1).otherwise(0).cast("long")).alias(f"{rule}_{i}_{q}") for q in (0, 1)]
    picked = held.where(~F.col("_second")).groupBy("lang").agg(*sums).mapInArrow(_each(choose, PICKED), PICKED).withColumnRenamed("lang", "_lang")
    with Scratch(measured.sparkSession, "rule-picks") as scratch:
        picked = scratch.keep(picked, "picked")  # one row per stratum
    joined = held.where("_second").join(picked, F.col("lang").eqNullSafe(F.col("_lang")))
    first = F.array_min(F.array(*(F.when(F.expr(_hit(r, f"cut_{r}")), F.col(f"place_{r}")) for r in RULES)))
    tested = joined.select("lang", "_q", first.alias("_first")).groupBy("lang").agg(F.sum(F.col("_q").cast("long")).alias("clean"), *(F.sum(F.when((F.col("_q") == 1) & (F.col("_first") <= i), 1).otherwise(0).cast("long")).alias(f"step_{i}") for i in range(1, len(RULES) + 1)))
    tested = picked.join(tested, F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn("lang", F.col("_lang"))
    level = delta / max(1, picked.count())

    def test(row: dict) -> dict:
        n, ps = certify(row, alpha, level)
        at = {r: row[f"place_{r}"] for r in RULES if row[f"place_{r}"]}
        return {"lang": row["lang"]} | {f"cut_{r}": row[f"cut_{r}"] for r, p in at.items() if p <= n} | {f"bound_{r}": ps[p - 1] for r, p in at.items()}

    return tested.select("lang", "clean", *(f"step_{i}" for i in range(1, len(RULES) + 1)), *PICKED.names[1:]).mapInArrow(_each(test, CERTIFIED), CERTIFIED)


def _cuts(thresholds: DataFrame) -> DataFrame:
    return thresholds.select(F.col("lang").alias("_lang"), *(F.col(f"cut_{r}").alias(f"_cut_{r}") for r in RULES))


def verdict(measured: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``measured`` with base_failed, kept, and the names of the rules that reject."""
    joined = measured.withColumn("base_failed", base_failed()).join(_cuts(thresholds), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    broken = F.filter(F.array(*(F.when(F.expr(f"CASE WHEN n_words > 0 THEN ({ratio}) > _cut_{r} END"), F.lit(r)) for r, (ratio, _) in RULES.items())), lambda x: x.isNotNull())
    return joined.withColumn("broken_rules", broken).withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0)).drop("_lang", *(f"_cut_{r}" for r in RULES))


def quality_rules(documents: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """COUNTS, base_failed, kept and broken_rules of every row; texts are read once."""
    with Scratch(documents.sparkSession, "quality-rules") as scratch:
        measured = scratch.table(measure(documents), "measured")
        return scratch.keep(verdict(measured, calibrate(measured, labels, alpha, delta)).drop("text_hash"))


def filter_documents(documents: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05, most: int = 500_000) -> DataFrame:
    """The rows of ``documents`` that are kept, with their columns.

    Up to ``most`` labelled documents are picked by a broadcast of their ids, so other texts are measured
    once; with more, all texts are measured for the cutoffs and again for the verdict.
    """
    with Scratch(documents.sparkSession, "quality-rules") as scratch:
        ids = scratch.table(labels.where("quality in (0, 1)").select("doc_id").distinct(), "labelled")
        labelled = documents.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= most else documents
        thresholds = scratch.keep(calibrate(scratch.table(measure(labelled), "measured"), labels, alpha, delta), "thresholds")
    row = documents.select(F.struct("*").alias("_row"), F.col("lang"), metrics(F.coalesce("text", F.lit(""))).alias("m")).select("_row", "lang", "m.*")
    return verdict(row, thresholds).where("kept").select("_row.*")
