"""Parsing, filtering, consolidation and statistics of n-gram corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as tk
from ..schema import CORPUS
from ..sources.shared import Steps


def _once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """``df`` with a column that is computed once, however often it is used: generators aren't merged with what follows."""
    return df.select("*", F.explode(F.array(column)).alias(name))


def _cells(value: Column) -> Column:
    """year, freq and doc of each cell after the first TAB; null where a cell is no triple of numbers.

    The line is split once and so is each cell: every step maps what the step before made.
    """
    split = F.transform(F.slice(F.split(value, "\t"), 2, 1 << 30), lambda c: F.split(F.trim(c), ","))
    number = lambda p, i, kind: F.when(F.size(p) == 3, F.get(p, i).try_cast(kind))
    read = F.transform(split, lambda p: F.struct(number(p, 0, "int").alias("year"), number(p, 1, "bigint").alias("freq"), number(p, 2, "bigint").alias("doc")))
    return F.transform(read, lambda y: F.when(y["year"].isNotNull() & y["freq"].isNotNull() & y["doc"].isNotNull(), y))


def _totals(parsed: DataFrame) -> DataFrame:
    total = lambda f: F.aggregate("years", F.lit(0).cast("long"), lambda s, y: s + y[f])
    return parsed.withColumn("freq_tot", total("freq")).withColumn("doc_tot", total("doc"))


def parse_strict(lines: DataFrame, tagged: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records, bad lines) of raw lines (column value).

    A record has tokens (word, pos), years (year, freq, doc), freq_tot and doc_tot. One bad cell, or
    in tagged mode one token without underscore, makes the whole line bad; bad lines are returned,
    never a reason to stop.
    """
    toks = tk.tokens(F.substring_index("value", "\t", 1))
    good = ~F.exists("years", lambda y: y.isNull())
    if tagged:
        good &= F.forall("toks", lambda t: t.contains("_"))
    read = _once(_once(lines.select("value"), "years", _cells(F.col("value"))), "toks", toks).withColumn("good", good)
    split = F.transform("toks", lambda t: F.struct(tk.word_of(t).alias("word"), tk.pos_of(t).alias("pos")) if tagged else F.struct(t.alias("word"), F.lit(None).cast("string").alias("pos")))
    return _totals(read.where("good").select(split.alias("tokens"), "years")), read.where(~F.col("good")).select("value")


def parse_tolerant(lines: DataFrame, kind: str = "all", carry: tuple[str, ...] = ()) -> DataFrame:
    """ngram and years of raw lines, with the columns ``carry``; blank lines and lines without TAB go, bad cells go one by one.

    The n-gram type is tested before any number is parsed.
    """
    own = lines.where(F.col("value").contains("\t") & (F.trim("value") != "")).select(*carry, "value", F.substring_index("value", "\t", 1).alias("ngram"))
    own = own.where(tk.ngram_type(kind)(F.col("ngram")))
    return _totals(_once(own, "years", F.filter(_cells(F.col("value")), lambda y: y.isNotNull())).select(*carry, "ngram", "years"))


def to_long(records: DataFrame, ngram: Column | str = "ngram") -> DataFrame:
    """One row per n-gram and year."""
    own = F.col(ngram) if isinstance(ngram, str) else ngram
    return records.select(own.alias("ngram"), F.explode("years").alias("y")).select("ngram", "y.*")


def consolidate(corpus: DataFrame) -> DataFrame:
    """Sums of freq and doc per n-gram and year; a missing count is 0."""
    zero = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    return corpus.groupBy("ngram", "year").agg(zero("freq"), zero("doc"))


def totals(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("ngram").agg(F.sum("freq").alias("freq_tot"), F.sum("doc").alias("doc_tot"))


def nested(corpus: DataFrame) -> DataFrame:
    """One row per n-gram with its years in order (consolidated first); years are at most some hundred."""
    by_year = consolidate(corpus)
    return by_year.groupBy("ngram").agg(F.sum("freq").alias("freq_tot"), F.sum("doc").alias("doc_tot"), F.sort_array(F.collect_list(F.struct("year", "freq", "doc"))).alias("frequencies"))


def merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Upsert by sum: both corpora as one."""
    return consolidate(left.select(CORPUS.names).unionByName(right.select(CORPUS.names)))


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key the row that is last by ``order``: the upsert that overwrites, without sorting a key's rows."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def lowercase(corpus: DataFrame) -> DataFrame:
    return consolidate(corpus.withColumn("ngram", F.lower("ngram")))


def lowercase_report(ngrams: DataFrame) -> DataFrame:
    """total, unique and collisions when distinct n-grams are lower-cased."""
    per = ngrams.select("ngram").distinct().groupBy(F.lower("ngram").alias("low")).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("total"), F.count("*").alias("uniq"), (F.sum("n") - F.count("*")).alias("collisions"))


def lemmatise(toks: DataFrame, lemmas: DataFrame, default_pos: str | None = "n") -> DataFrame:
    """(.., word, pos) with word replaced by its lemma; ``lemmas`` is (surface, pos, lemma).

    Tags without a part of speech take ``default_pos``; with None they stay as they are.
    """
    tags = F.create_map(*(F.lit(x) for kv in tk.LEMMA_POS.items() for x in kv))
    own = toks.withColumn("_pos", F.coalesce(F.try_element_at(tags, F.col("pos")), F.lit(default_pos)))
    table = lemmas.select(F.col("surface").alias("_surface"), F.col("pos").alias("_lpos"), "lemma")
    joined = own.join(table, (F.col("word") == F.col("_surface")) & (F.col("_pos") == F.col("_lpos")), "left")
    return joined.withColumn("word", F.coalesce("lemma", "word")).drop("_pos", "_surface", "_lpos", "lemma", "pos")


def token_reasons(words: DataFrame, spec: tk.TokenFilter, vocabulary: DataFrame) -> DataFrame:
    """(token, reason) of distinct tokens (column token), each decided once; ``vocabulary`` (column word) is a table of any size.

    A token outside the vocabulary (compared in lower case) fails as ``vocab``, before any other test; a null reason passes.
    Spark broadcasts the smaller side where its size allows and joins by hash otherwise.
    """
    known = vocabulary.select(F.lower("word").alias("_low")).distinct().withColumn("_known", F.lit(True))
    own = words.select("token").distinct().withColumn("_low", F.lower("token")).join(known, "_low", "left")
    return own.select("token", F.when(F.col("_known").isNull(), F.lit("vocab")).otherwise(spec.reason(F.col("token"))).alias("reason"))


def known(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(_marks, _kept) of distinct arrays ``_marks``: the same tokens, null also where one isn't in the vocabulary (column word, in lower case).

    Only tokens that are left are looked up. A frequent token is many rows on one side of the join and
    one on the other, so adaptive execution can split it.
    """
    each = rows.select("_marks").distinct()
    words = each.select(F.explode("_marks").alias("token")).where("token is not null").distinct()
    listed = vocabulary.select(F.lower("word").alias("_low")).distinct()
    words = words.withColumn("_low", F.lower("token")).join(listed, "_low", "left_semi").select("token", F.lit(True).alias("_in"))
    places = each.select("_marks", F.posexplode_outer("_marks").alias("at", "token")).join(words, "token", "left")
    held = places.groupBy("_marks").agg(F.collect_list(F.when(F.col("_in"), F.col("at"))).alias("_at"))
    return held.select("_marks", F.transform("_marks", lambda t, i: F.when(F.array_contains("_at", i), t)).alias("_kept"))


def filter_counts(ngrams: DataFrame, spec: tk.TokenFilter, min_tokens: int = 2, vocabulary: DataFrame | None = None) -> DataFrame:
    """One row: tokens dropped for each reason, and n-grams dropped; with a ``vocabulary`` table, its test comes first."""
    names, tested = ("stop", "short", "numeral", "nonalpha", "vocab"), F.transform(tk.tokens(F.col("ngram")), spec.reason)
    few = lambda passed: (passed < min_tokens) | (passed == 0)
    lost = lambda passed, n: F.coalesce(F.sum(F.when(few(passed), n)), F.lit(0)).cast("long")
    if vocabulary is None:
        out = _once(ngrams.select("ngram"), "reasons", tested)
        hits = lambda name: F.coalesce(F.sum(F.size(F.filter("reasons", lambda r: r == name))), F.lit(0)).cast("long").alias(f"dropped_{name}")
        return out.agg(*(hits(n) for n in names), lost(F.size(F.filter("reasons", lambda r: r.isNull())), F.lit(1)).alias("dropped_ngrams"))
    # Reasons are a matter of tokens, each decided once; only n-grams that no other test drops are looked up as such. Both are written: the corpus is read twice.
    with Steps(ngrams.sparkSession, "counts") as steps:
        each = steps.table(ngrams.select(F.explode(tk.tokens(F.col("ngram"))).alias("token")).groupBy("token").agg(F.count("*").alias("n")), "tokens")
        told = steps.table(each.join(token_reasons(each, spec, vocabulary), "token"), "told")
        hits = lambda name: F.coalesce(F.sum(F.when(F.col("reason") == name, F.col("n"))), F.lit(0)).cast("long").alias(f"dropped_{name}")
        rows = _once(ngrams.select("ngram"), "_marks", F.array_compact(tk.marked(tk.tokens(F.col("ngram")), spec)))
        rows = steps.table(rows.groupBy(F.when(~few(F.size("_marks")), F.col("_marks")).alias("_marks")).agg(F.count("*").alias("n")), "rows")
        rest = rows.where("_marks is not null")
        rest = rest.join(known(rest, told.where("reason is null").select(F.col("token").alias("word"))), "_marks").select("n", F.size(F.array_compact("_kept")).alias("passed"))
        rest = rest.union(rows.where("_marks is null").select("n", F.lit(0).alias("passed")))
        return steps.keep(told.agg(*(hits(n) for n in names)).crossJoin(rest.agg(lost(F.col("passed"), F.col("n")).alias("dropped_ngrams"))))


def kept_ngrams(corpus: DataFrame, spec: tk.TokenFilter, min_tokens: int = 2, unk: str | None = None, count_unk: bool = True) -> DataFrame:
    """(ngram, year, freq, doc) of a corpus with what the filter leaves of each n-gram, yet to be summed.

    It goes by rows, so a corpus that isn't summed itself can be given: its rows meet once, by what is left of them.
    """
    marked = _once(corpus, "_marks", tk.marked(tk.tokens(F.col("ngram")), spec))
    kept = _once(marked, "_kept", tk.survivors(F.col("_marks"), min_tokens, unk, count_unk)).where("_kept is not null")
    return kept.select(F.col("_kept").alias("ngram"), "year", "freq", "doc")


def filter_ngrams(corpus: DataFrame, spec: tk.TokenFilter, min_tokens: int = 2, unk: str | None = None, count_unk: bool = True, vocabulary: DataFrame | None = None) -> DataFrame:
    """The corpus (summed or not) with filtered n-grams, consolidated. ``vocabulary`` is a table of the words (column word) that may stay."""
    if vocabulary is None:
        return consolidate(kept_ngrams(corpus, spec, min_tokens, unk, count_unk))
    # What the tests leave is summed before words are looked up: n-grams that differ in failing tokens alone are one.
    marked = _once(corpus, "_marks", tk.marked(tk.tokens(F.col("ngram")), spec))
    zero = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    own = marked.where(F.size(F.array_compact("_marks")) > 0).groupBy("_marks", "year").agg(zero("freq"), zero("doc"))
    with Steps(corpus.sparkSession, "filter") as steps:
        own = steps.keep(own, "rows")  # read three times
    marked = own.join(known(own, vocabulary), "_marks").select("year", "freq", "doc", F.col("_kept").alias("_marks"))
    kept = _once(marked, "_kept", tk.survivors(F.col("_marks"), min_tokens, unk, count_unk)).where("_kept is not null")
    return consolidate(kept.withColumn("ngram", F.col("_kept")))


def fused(lines: DataFrame, kind: str, spec: tk.TokenFilter, min_tokens: int = 1, lower: bool = True, unk: str | None = None, vocabulary: DataFrame | None = None) -> DataFrame:
    """Raw lines to a consolidated corpus in one plan: type, tags off, lower case, filter (also by a vocabulary table), sum."""
    own = parse_tolerant(lines, kind)
    toks = F.transform(tk.tokens(F.col("ngram")), lambda t: tk.split_known_tag(t)["word"])
    toks = F.transform(toks, F.lower) if lower else toks
    if vocabulary is not None:
        plain = to_long(own.select(F.array_join(toks, " ").alias("ngram"), "years"))
        return filter_ngrams(plain, spec, min_tokens, unk, count_unk=False, vocabulary=vocabulary)
    out = _once(own, "_marks", tk.marked(toks, spec))
    out = _once(out, "_kept", tk.survivors(F.col("_marks"), min_tokens, unk, count_unk=False)).where("_kept is not null")
    return consolidate(to_long(out, "_kept"))


def yearly(corpus: DataFrame, path: str | None = None) -> DataFrame:
    """One row per year and n-gram; written partitioned by year if a path is given."""
    out = corpus.select("year", "ngram", "freq", F.coalesce("doc", F.lit(0)).alias("doc"))
    if path:
        # Several files per year: a year with a large share of all rows is not one task.
        out.repartition("year", F.pmod(F.xxhash64("ngram"), F.lit(16))).write.mode("overwrite").partitionBy("year").parquet(path)
    return out


def corpus_stats(corpus: DataFrame, *by: str) -> DataFrame:
    keys = ["year", *by]
    return corpus.groupBy(*keys).agg(F.count("*").alias("unique_ngrams"), F.sum(F.coalesce("freq", F.lit(0))).alias("total_freq"), F.sum(F.coalesce("doc", F.lit(0))).alias("total_docs"))


def replicate(corpus: DataFrame, weight: Column) -> DataFrame:
    """Each row as often as its weight, for trainers that take no weights."""
    return corpus.withColumn("copy", F.explode(F.sequence(F.lit(1), weight)))
