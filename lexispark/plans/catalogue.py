"""The registered queries of the engine and their DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as tk
from ..functions.vectors import norm
from ..operators import alignment, buckets, corpus, evaluation, order, series, training, vectors, vocabularies, word2vec
from ..operators.counting import dealt
from ..sources import shards
from ..sources.shared import Steps, shared_folder
from ..streaming import incremental
from . import fixtures as fx
from .fixtures import with_sql

STOPS = ("the", "of", "and", "to", "in", "that", "with", "is", "for", "was")
LEMMAS = [("was", "n", "be"), ("is", "n", "be"), ("are", "n", "be"), ("the", "n", "a"), ("of", "a", "off"), ("and", "r", "plus")]
_STOPS_SQL = "(" + ", ".join(f"'{w}'" for w in STOPS) + ")"
_QUERIES: dict = {}
_SQL: dict[str, str] = {}
SPEC = tk.TokenFilter(stops=STOPS)


def query(sql: str | None = None, *relations: str):
    """Register a query, and its SQL over the named relations."""

    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = with_sql(sql, *relations) if relations else sql
        return f

    return register


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _reason(token: str) -> str:
    return f"CASE WHEN lower({token}) IN {_STOPS_SQL} THEN 'stop' WHEN regexp_matches({token}, '[0-9]') THEN 'numeral' WHEN regexp_matches({token}, '[^a-zA-Z]') THEN 'nonalpha' WHEN length({token}) < 3 THEN 'short' END"


# --- vocabulary, parsing -------------------------------------------------------------------------


@query(f"""SELECT ngram, CAST(freq_tot AS BIGINT) AS freq_tot, row_number() OVER (ORDER BY freq_tot DESC, ngram) AS idx
FROM (SELECT lower(word) AS ngram, count(*) AS freq_tot FROM tok WHERE {_reason('word')} IS NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100)""", "tok")
def vocab_topn(spark, sf) -> DataFrame:
    words = F.filter(tk.tokens(F.col("text")), lambda t: SPEC.reason(t).isNull())
    t = fx.documents(spark, sf).select(F.explode(words).alias("word"))
    return order.top_vocabulary(t.groupBy(F.lower("word").alias("ngram")).agg(F.count("*").alias("freq_tot")), 100)


_CELL = "try_cast(string_split(c, ',')[{}] AS BIGINT)"
_PARSED = f"""c AS (SELECT string_split(value, chr(9))[1] AS ngram, unnest(string_split(value, chr(9))[2:]) AS c FROM raw_line),
n AS (SELECT ngram, CASE WHEN len(string_split(c, ',')) = 3 THEN {_CELL.format(1)} END AS year, {_CELL.format(2)} AS freq, {_CELL.format(3)} AS doc FROM c)"""


@query(f"WITH {_PARSED} SELECT regexp_extract(ngram, '^(.*)_([^_]*)$', 1) AS word, regexp_extract(ngram, '^(.*)_([^_]*)$', 2) AS pos, CAST(sum(freq) AS BIGINT) AS freq_tot, CAST(sum(doc) AS BIGINT) AS doc_tot, count(*) AS n_years FROM n GROUP BY ngram HAVING count(*) = count(year)", "raw_line")
def parse_strict(spark, sf) -> DataFrame:
    good, _ = corpus.parse_strict(fx.raw_line(spark, sf))
    return good.select(F.col("tokens")[0]["word"].alias("word"), F.col("tokens")[0]["pos"].alias("pos"), "freq_tot", "doc_tot", F.size("years").cast("long").alias("n_years"))


@query(f"WITH {_PARSED} SELECT count(*) AS bad_lines FROM (SELECT ngram FROM n GROUP BY ngram HAVING count(*) <> count(year))", "raw_line")
def parse_bad_records(spark, sf) -> DataFrame:
    return corpus.parse_strict(fx.raw_line(spark, sf))[1].agg(F.count("*").alias("bad_lines"))


@query(f"WITH {_PARSED} SELECT ngram, CAST(year AS INT) AS year, freq, doc FROM n WHERE year IS NOT NULL", "raw_line")
def parse_tolerant(spark, sf) -> DataFrame:
    return corpus.to_long(corpus.parse_tolerant(fx.raw_line(spark, sf), "tagged"))


@query("SELECT pos, count(*) AS n, CAST(sum(length(word)) AS BIGINT) AS chars FROM (SELECT regexp_extract(string_split(value, chr(9))[1], '^(.*)_([^_]*)$', 1) AS word, regexp_extract(string_split(value, chr(9))[1], '^(.*)_([^_]*)$', 2) AS pos FROM raw_line) GROUP BY pos", "raw_line")
def pos_split(spark, sf) -> DataFrame:
    token = F.get(F.split("value", "\t"), 0)
    return fx.raw_line(spark, sf).select(tk.split_known_tag(token).alias("t")).groupBy(F.col("t.pos").alias("pos")).agg(F.count("*").alias("n"), F.sum(F.length("t.word")).alias("chars"))


_MIXED = "SELECT string_split(value, chr(9))[1] AS g FROM raw_line UNION ALL SELECT word AS g FROM tok"
_TAG_SQL = "(NOUN|PROPN|VERB|ADJ|ADV|PRON|DET|ADP|NUM|CONJ|X|[.])"


def _mixed(spark, sf) -> DataFrame:
    """(g, k): each of them once, with how often it occurs."""
    both = fx.raw_line(spark, sf).select(F.get(F.split("value", "\t"), 0).alias("g"), F.lit(1).alias("k")).union(fx.tok(spark, sf).groupBy("word").agg(F.count("*")))
    return both.groupBy("g").agg(F.sum("k").alias("k"))


def _times(rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.sum(F.col("k") * F.length("g")).alias("chars"))


@query(f"SELECT count(*) AS n, CAST(sum(length(g)) AS BIGINT) AS chars FROM ({_MIXED}) WHERE regexp_matches(g, '^.+_{_TAG_SQL}$')", "raw_line", "tok")
def ngram_type_tagged(spark, sf) -> DataFrame:
    return _times(_mixed(spark, sf).where(tk.is_tagged(F.col("g"))))


@query(f"SELECT count(*) AS n, CAST(sum(length(g)) AS BIGINT) AS chars FROM ({_MIXED}) WHERE NOT regexp_matches(g, '_{_TAG_SQL}')", "raw_line", "tok")
def ngram_type_untagged(spark, sf) -> DataFrame:
    return _times(_mixed(spark, sf).where(tk.is_untagged(F.col("g"))))


# --- projections and filters ---------------------------------------------------------------------


@query("SELECT lower(word) AS ngram, count(DISTINCT word) AS variants, count(*) AS freq FROM tok GROUP BY 1 HAVING count(DISTINCT word) > 1", "tok")
def lowercase_collisions(spark, sf) -> DataFrame:
    per = fx.tok(spark, sf).groupBy("word").agg(F.count("*").alias("n"))
    return per.groupBy(F.lower("word").alias("ngram")).agg(F.count("*").alias("variants"), F.sum("n").alias("freq")).where("variants > 1")


@query("SELECT count(DISTINCT word) AS total, count(DISTINCT lower(word)) AS uniq, count(DISTINCT word) - count(DISTINCT lower(word)) AS collisions FROM tok", "tok")
def lowercase_stats(spark, sf) -> DataFrame:
    return corpus.lowercase_report(fx.tok(spark, sf).select(F.col("word").alias("ngram")))


@query("SELECT year, lower(ngram) AS ngram, CAST(sum(freq) AS BIGINT) AS freq, CAST(sum(doc) AS BIGINT) AS doc FROM ng1 GROUP BY 1, 2", "ng1")
def lowercase_corpus(spark, sf) -> DataFrame:
    return corpus.lowercase(fx.ng1(spark, sf))


@query("""SELECT coalesce(l.lemma, t.word) AS word, count(*) AS n FROM (SELECT word, CASE length(word) % 6 WHEN 0 THEN 'n' WHEN 1 THEN 'v' WHEN 2 THEN 'a' WHEN 3 THEN 'r' ELSE 'n' END AS p FROM tok) t
LEFT JOIN (VALUES ('was', 'n', 'be'), ('is', 'n', 'be'), ('are', 'n', 'be'), ('the', 'n', 'a'), ('of', 'a', 'off'), ('and', 'r', 'plus')) l(surface, pos, lemma) ON t.word = l.surface AND t.p = l.pos GROUP BY 1""", "tok")
def lemmatize_lookup(spark, sf) -> DataFrame:
    tag = F.when(F.length("word") % 6 == 0, "NOUN").when(F.length("word") % 6 == 1, "VERB").when(F.length("word") % 6 == 2, "ADJ").when(F.length("word") % 6 == 3, "ADV").otherwise("DET")
    table = spark.createDataFrame(LEMMAS, "surface string, pos string, lemma string")
    return corpus.lemmatise(fx.tok(spark, sf).drop("pos").withColumn("pos", tag), table).groupBy("word").agg(F.count("*").alias("n"))


@query(f"SELECT coalesce({_reason('word')}, 'pass') AS reason, count(*) AS n FROM tok GROUP BY 1", "tok")
def filter_reasons(spark, sf) -> DataFrame:
    return fx.tok(spark, sf).groupBy(F.coalesce(SPEC.reason(F.col("word")), F.lit("pass")).alias("reason")).agg(F.count("*").alias("n"))


_TWO = f"""WITH p AS (SELECT *, string_split(ngram, ' ')[1] AS t1, string_split(ngram, ' ')[2] AS t2 FROM ng2),
r AS (SELECT *, {_reason('t1')} AS r1, {_reason('t2')} AS r2 FROM p)"""


@query(f"""{_TWO} SELECT {', '.join(f"CAST(count(*) FILTER (WHERE r1 = '{x}') + count(*) FILTER (WHERE r2 = '{x}') AS BIGINT) AS dropped_{x}" for x in ('stop', 'short', 'numeral', 'nonalpha', 'vocab'))},
count(*) FILTER (WHERE r1 IS NOT NULL OR r2 IS NOT NULL) AS dropped_ngrams FROM r""", "ng2")
def filter_drop_counts(spark, sf) -> DataFrame:
    return corpus.filter_counts(fx.ng2(spark, sf), SPEC, min_tokens=2)


def _filtered_pairs(spark, sf, min_tokens: int, unk: str | None = None) -> DataFrame:
    """Pairs are filtered as they are counted, and dealt once, by what is left of them."""
    kept = corpus.kept_ngrams(fx.pairs(spark, sf), SPEC, min_tokens, unk)
    return corpus.consolidate(dealt(kept, fx.documents(spark, sf)))


@query(f"""{_TWO} SELECT concat(CASE WHEN r1 IS NULL THEN t1 ELSE 'UNK' END, ' ', CASE WHEN r2 IS NULL THEN t2 ELSE 'UNK' END) AS ngram, year, CAST(sum(freq) AS BIGINT) AS freq, CAST(sum(doc) AS BIGINT) AS doc
FROM r WHERE r1 IS NULL OR r2 IS NULL GROUP BY 1, 2""", "ng2")
def filter_unk(spark, sf) -> DataFrame:
    return _filtered_pairs(spark, sf, 2, "UNK")


@query(f"""{_TWO} SELECT concat_ws(' ', CASE WHEN r1 IS NULL THEN t1 END, CASE WHEN r2 IS NULL THEN t2 END) AS ngram, year, CAST(sum(freq) AS BIGINT) AS freq, CAST(sum(doc) AS BIGINT) AS doc
FROM r WHERE r1 IS NULL OR r2 IS NULL GROUP BY 1, 2""", "ng2")
def filter_min_tokens(spark, sf) -> DataFrame:
    return _filtered_pairs(spark, sf, 1)


@query(f"""WITH {_PARSED}, w AS (SELECT lower(regexp_extract(ngram, '^(.*)_([^_]*)$', 1)) AS word, year, freq, doc FROM n WHERE year IS NOT NULL)
SELECT word AS ngram, CAST(year AS INT) AS year, CAST(sum(freq) AS BIGINT) AS freq, CAST(sum(doc) AS BIGINT) AS doc FROM w WHERE {_reason('word')} IS NULL GROUP BY 1, 2""", "raw_line")
def fused_pipeline(spark, sf) -> DataFrame:
    return corpus.fused(fx.raw_line(spark, sf), "tagged", SPEC)


def _common(spark, sf) -> DataFrame:
    """A vocabulary that grows with the corpus: words in lower case that occur in two years or more, stop words and all."""
    words = fx.tok(spark, sf).select(F.lower("word").alias("word"), "year").distinct()
    return words.groupBy("word").agg(F.count("*").alias("n")).where("n > 1").select("word")


_COMMON = "voc AS (SELECT lower(word) AS word FROM tok GROUP BY 1 HAVING count(DISTINCT year) > 1)"
_BY_WORD = f"""WITH {_COMMON}, p AS (SELECT *, string_split(ngram, ' ')[1] AS t1, string_split(ngram, ' ')[2] AS t2 FROM ng2),
r AS (SELECT p.*, CASE WHEN a.word IS NULL THEN 'vocab' ELSE {_reason('t1')} END AS r1, CASE WHEN b.word IS NULL THEN 'vocab' ELSE {_reason('t2')} END AS r2
  FROM p LEFT JOIN voc a ON a.word = lower(t1) LEFT JOIN voc b ON b.word = lower(t2))"""


@query(f"""{_BY_WORD} SELECT {', '.join(f"CAST(count(*) FILTER (WHERE r1 = '{x}') + count(*) FILTER (WHERE r2 = '{x}') AS BIGINT) AS dropped_{x}" for x in ('stop', 'short', 'numeral', 'nonalpha', 'vocab'))},
count(*) FILTER (WHERE r1 IS NOT NULL OR r2 IS NOT NULL) AS dropped_ngrams FROM r""", "tok", "ng2")
def vocabulary_drop_counts(spark, sf) -> DataFrame:
    """Reasons with a vocabulary table, whose test comes first."""
    return corpus.filter_counts(fx.ng2(spark, sf), SPEC, min_tokens=2, vocabulary=_common(spark, sf))


@query(f"""{_BY_WORD} SELECT concat(CASE WHEN r1 IS NULL THEN t1 ELSE 'UNK' END, ' ', CASE WHEN r2 IS NULL THEN t2 ELSE 'UNK' END) AS ngram, year, CAST(sum(freq) AS BIGINT) AS freq, CAST(sum(doc) AS BIGINT) AS doc
FROM r WHERE r1 IS NULL OR r2 IS NULL GROUP BY 1, 2""", "tok", "ng2")
def vocabulary_filter(spark, sf) -> DataFrame:
    return corpus.filter_ngrams(fx.ng2(spark, sf), SPEC, 2, unk="UNK", vocabulary=_common(spark, sf))


@query(f"""WITH {_COMMON}, {_PARSED}, w AS (SELECT lower(regexp_extract(ngram, '^(.*)_([^_]*)$', 1)) AS word, year, freq, doc FROM n WHERE year IS NOT NULL)
SELECT word AS ngram, CAST(year AS INT) AS year, CAST(sum(freq) AS BIGINT) AS freq, CAST(sum(doc) AS BIGINT) AS doc FROM w WHERE word IN (SELECT word FROM voc) AND {_reason('word')} IS NULL GROUP BY 1, 2""", "tok", "raw_line")
def vocabulary_fused(spark, sf) -> DataFrame:
    return corpus.fused(fx.raw_line(spark, sf), "tagged", SPEC, vocabulary=_common(spark, sf))


@query(f"""SELECT CASE WHEN length(w) < 3 OR NOT regexp_matches(w, '^\\p{{L}}+$') OR w IN {_STOPS_SQL} THEN '<UNK>' ELSE w END AS ngram, count(*) AS n FROM (SELECT lower(word) AS w FROM tok) GROUP BY 1""", "tok")
def key_normalize(spark, sf) -> DataFrame:
    key = tk.normalised_key(F.col("word"), lower=True, alpha=True, shorts=3, stops=STOPS)
    return fx.tok(spark, sf).groupBy(key.alias("ngram")).agg(F.count("*").alias("n"))


# --- aggregation -----------------------------------------------------------------------------------


@query("SELECT ngram, year, CAST(2 * sum(freq) AS BIGINT) AS freq, CAST(2 * sum(doc) AS BIGINT) AS doc FROM ng2 GROUP BY 1, 2", "ng2")
def consolidate_long(spark, sf) -> DataFrame:
    own = fx.ng2(spark, sf)
    return corpus.merge(own, own)


@query("SELECT ngram, CAST(sum(freq) AS BIGINT) AS freq_tot, CAST(sum(doc) AS BIGINT) AS doc_tot FROM ng2 GROUP BY 1", "ng2")
def consolidate_totals(spark, sf) -> DataFrame:
    return corpus.totals(fx.ng2(spark, sf))


@query("SELECT ngram, CAST(sum(freq) AS BIGINT) AS freq_tot, CAST(sum(doc) AS BIGINT) AS doc_tot, string_agg(concat(year, ':', freq, ':', doc), ';' ORDER BY year) AS years FROM ng1 GROUP BY 1", "ng1")
def consolidate_yearlist(spark, sf) -> DataFrame:
    years = F.array_join(F.transform("frequencies", lambda y: F.concat_ws(":", y["year"], y["freq"], y["doc"])), ";")
    return corpus.nested(fx.ng1(spark, sf)).select("ngram", "freq_tot", "doc_tot", years.alias("years"))


@query("SELECT year, count(*) AS unique_ngrams, CAST(sum(freq) AS BIGINT) AS total_freq, CAST(sum(doc) AS BIGINT) AS total_docs FROM ng1 GROUP BY 1", "ng1")
def corpus_stats(spark, sf) -> DataFrame:
    return corpus.corpus_stats(fx.ng1(spark, sf))


@query("SELECT year, lang, count(*) AS unique_ngrams, CAST(sum(freq) AS BIGINT) AS total_freq, CAST(sum(doc) AS BIGINT) AS total_docs FROM (SELECT year, lang, word, count(*) AS freq, count(DISTINCT doc_id) AS doc FROM tok GROUP BY 1, 2, 3) GROUP BY 1, 2", "tok")
def corpus_stats_by_lang(spark, sf) -> DataFrame:
    return corpus.corpus_stats(fx.words(spark, sf, "year", "lang"), "lang")


@query("SELECT count(*) AS n_items FROM ng1", "ng1")
def count_items(spark, sf) -> DataFrame:
    return fx.ng1(spark, sf).agg(F.count("*").alias("n_items"))


@query("SELECT year, ngram, freq, doc FROM ng1", "ng1")
def yearly_explode(spark, sf) -> DataFrame:
    records = corpus.nested(fx.ng1(spark, sf)).withColumnRenamed("frequencies", "years")
    return corpus.yearly(corpus.to_long(records))


@query("SELECT year, ngram, freq, doc FROM ng1 WHERE year = 2007", "ng1")
def yearly_one_year(spark, sf) -> DataFrame:
    return corpus.yearly(fx.ng1(spark, sf)).where("year = 2007")


_PREFIX = "concat(" + ", ".join(f"coalesce(nullif(regexp_extract(lower(string_split(ngram, ' ')[{i}]), '^[a-z]'), ''), '_')" for i in (1, 2, 3)) + ")"
_HIST = f"h AS (SELECT {_PREFIX} AS prefix, count(*) AS total FROM ng2 GROUP BY 1)"


@query(f"WITH {_HIST} SELECT prefix, total FROM h", "ng2")
def prefix_histogram(spark, sf) -> DataFrame:
    return order.prefix_histogram(fx.ng2(spark, sf), 3)


@query(f"WITH {_HIST}, l AS (SELECT unnest(range(0, 4)) AS length) SELECT CAST(length AS INT) AS length, substr(prefix, 1, CAST(length AS INT)) AS prefix, CAST(sum(total) AS BIGINT) AS total FROM h, l GROUP BY 1, 2", "ng2")
def prefix_rollup(spark, sf) -> DataFrame:
    return order.prefix_rollup(order.prefix_histogram(fx.ng2(spark, sf), 3), 3)


@query(f"""WITH {_HIST}, b AS (SELECT prefix, total, CAST(floor(coalesce(sum(total) OVER (ORDER BY prefix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 20 / (SELECT sum(total) FROM h)) AS BIGINT) AS bucket FROM h)
SELECT bucket, CAST(sum(total) AS BIGINT) AS n, min(prefix) AS first_prefix, max(prefix) AS last_prefix FROM b GROUP BY 1""", "ng2")
def bucket_assign(spark, sf) -> DataFrame:
    own = fx.ng2(spark, sf)
    bucketed = order.buckets(order.prefix_histogram(own, 3), 20)
    return order.assign_buckets(own, bucketed, 3).groupBy("bucket").agg(F.count("*").alias("n"), F.min("prefix").alias("first_prefix"), F.max("prefix").alias("last_prefix"))


_KEY5 = "concat(" + ", ".join(f"coalesce(nullif(regexp_extract(lower(coalesce(string_split(ngram, ' ')[{i}], '')), '^[a-z]'), ''), '_')" for i in range(1, 6)) + ")"
#: The recursive twin: a prefix over the target is split, level by level; the target is moved up to five times.
_CUT = f"""k AS (SELECT {_KEY5} AS key, ngram, freq FROM ng2), h AS (SELECT key, count(*) AS total FROM k GROUP BY 1),
y AS (SELECT l, substr(key, 1, CAST(l AS INT)) AS prefix, CAST(sum(total) AS BIGINT) AS total FROM h, (SELECT unnest(range(0, 4)) AS l) GROUP BY 1, 2),
o AS (SELECT a.*, b.total AS above FROM y a LEFT JOIN y b ON b.l = a.l - 1 AND b.prefix = substr(a.prefix, 1, CAST(a.l - 1 AS INT))),
t AS (SELECT 0 AS i, CAST((SELECT sum(total) FROM h) AS DOUBLE) / 20 AS target UNION ALL
  SELECT i + 1, CASE WHEN n > 20 THEN target * 1.1 ELSE target * 0.9 END FROM (SELECT i, target, (SELECT count(*) FROM o WHERE (o.total <= t.target OR l = 3) AND (above IS NULL OR above > t.target)) AS n FROM t WHERE i < 5) WHERE n <> 20),
c AS (SELECT l, prefix, total FROM y WHERE l = 0 UNION ALL SELECT y.l, y.prefix, y.total FROM c JOIN y ON y.l = c.l + 1 AND starts_with(y.prefix, c.prefix) WHERE c.l < 3 AND c.total > (SELECT arg_max(target, i) FROM t)),
b AS (SELECT prefix, total FROM c WHERE l = 3 OR total <= (SELECT arg_max(target, i) FROM t))"""


def _partition(histogram: DataFrame) -> DataFrame:
    return buckets.partition(histogram.select("prefix", "total"), 20, 3)


@query(f"WITH {_CUT} SELECT prefix, total, row_number() OVER (ORDER BY prefix) - 1 AS ord FROM b", "ng2")
def prefix_partition(spark, sf) -> DataFrame:
    return _partition(order.prefix_histogram(fx.ng2(spark, sf), 5))


@query(f"""WITH {_CUT}, m AS (SELECT prefix, 10 - length(prefix) AS ord FROM b UNION ALL SELECT chr(CAST(97 + u AS INT)), 5 FROM (SELECT unnest(range(0, 13)) AS u)),
f AS (SELECT k.key, min((m.ord, m.prefix)) AS m FROM (SELECT DISTINCT key FROM k) k JOIN m ON starts_with(k.key, m.prefix) GROUP BY 1)
SELECT f.m[2] AS bucket, count(*) AS n, CAST(sum(k.freq) AS BIGINT) AS freq FROM k LEFT JOIN f ON f.key = k.key GROUP BY 1""", "ng2")
def bucket_first_match(spark, sf) -> DataFrame:
    """N-grams by the first match in a list of overlapping prefixes: the letters a-m, then longer buckets before shorter ones."""
    # N-grams with one key have one bucket, so the keys are matched: the pairs are counted once, for the list and for the rows.
    keys = Steps(spark, "keys").keep(order.prefix_histogram(fx.ng2(spark, sf), 5, "freq"))
    cut = _partition(keys).select("prefix", (10 - F.length("prefix")).cast("long").alias("ord"))
    letters = spark.range(13).select(F.char((97 + F.col("id")).cast("int")).alias("prefix"), F.lit(5).cast("long").alias("ord"))
    matched = buckets.first_match(keys.withColumnRenamed("prefix", "key"), cut.union(letters), key=F.col("key"))
    return matched.groupBy("bucket").agg(F.sum("total").alias("n"), F.sum("freq").alias("freq"))


# --- order, windows, samples -------------------------------------------------------------------------


@query("SELECT ngram, freq_tot, row_number() OVER (ORDER BY freq_tot DESC, ngram) AS idx FROM (SELECT ngram, CAST(sum(freq) AS BIGINT) AS freq_tot FROM ng1 GROUP BY 1)", "ng1")
def sort_index(spark, sf) -> DataFrame:
    return order.dense_index(corpus.totals(fx.ng1(spark, sf)).select("ngram", "freq_tot"))


@query("""WITH t AS (SELECT doc_id, word, lag(word) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM tok) SELECT doc_id, count(*) FILTER (WHERE b > word) = 0 AS is_sorted FROM t GROUP BY 1""", "tok")
def sort_check(spark, sf) -> DataFrame:
    return order.is_sorted(fx.tok(spark, sf), "word", "pos", by=["doc_id"])


@query("SELECT year, ngram, freq FROM ng1 ORDER BY freq DESC, year, ngram LIMIT 20 OFFSET 10", "ng1")
def head_slice(spark, sf) -> DataFrame:
    return order.head_slice(fx.ng1(spark, sf), [F.col("freq").desc(), "year", "ngram"], 11, 30).select("year", "ngram", "freq")


@query("SELECT year, ngram, freq FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY freq DESC, ngram) AS r FROM ng1) WHERE r <= 5", "ng1")
def per_file_limit(spark, sf) -> DataFrame:
    return order.first_per_group(fx.ng1(spark, sf), ["year"], [F.col("freq").desc(), "ngram"], 5).select("year", "ngram", "freq")


@query("SELECT ngram, freq_tot FROM (SELECT ngram, CAST(sum(freq) AS BIGINT) AS freq_tot FROM ng1 GROUP BY 1) ORDER BY lower(ngram), ngram LIMIT 200", "ng1")
def global_sort_head(spark, sf) -> DataFrame:
    return order.global_sort(corpus.totals(fx.ng1(spark, sf)).select("ngram", "freq_tot")).limit(200)


@query("SELECT ngram, freq_tot FROM (SELECT ngram, CAST(sum(freq) AS BIGINT) AS freq_tot FROM ng1 GROUP BY 1) ORDER BY md5(concat(ngram, '#7')), ngram LIMIT 250", "ng1")
def reservoir_sample_md5(spark, sf) -> DataFrame:
    return order.sample(corpus.totals(fx.ng1(spark, sf)).select("ngram", "freq_tot"), "ngram", 250, seed=7)


@query("SELECT ngram, year, freq, doc FROM (SELECT *, row_number() OVER (PARTITION BY ngram ORDER BY year DESC) AS r FROM ng1) WHERE r = 1", "ng1")
def dedup_last(spark, sf) -> DataFrame:
    return corpus.last_wins(fx.ng1(spark, sf).select("ngram", "year", "freq", "doc"), ["ngram"], ["year"])


# --- vocabularies as sets -----------------------------------------------------------------------------


def _words(spark, sf, year: int) -> DataFrame:
    return fx.tok(spark, sf).where(F.col("year") == year).select("word")


_A, _B = "(SELECT DISTINCT word FROM tok WHERE year = 2001)", "(SELECT DISTINCT word FROM tok WHERE year = 2002)"


@query(f"SELECT word, count(*) AS n FROM tok WHERE word IN {_A} GROUP BY 1", "tok")
def vocab_semi(spark, sf) -> DataFrame:
    counts = fx.tok(spark, sf).groupBy("word").agg(F.count("*").alias("n"))  # a word is a row of the join, however frequent
    return vocabularies.keep(counts, _words(spark, sf, 2001))


@query(f"SELECT year, count(*) AS n FROM tok WHERE lower(word) NOT IN {_STOPS_SQL} GROUP BY 1", "tok")
def stop_anti(spark, sf) -> DataFrame:
    stops = spark.createDataFrame([(w,) for w in STOPS], "word string")
    return vocabularies.drop(fx.tok(spark, sf).select("year", F.lower("word").alias("word")), stops).groupBy("year").agg(F.count("*").alias("n"))


@query(f"SELECT word FROM {_A} INTERSECT SELECT word FROM {_B}", "tok")
def vocab_intersect(spark, sf) -> DataFrame:
    return vocabularies.intersection(_words(spark, sf, 2001), _words(spark, sf, 2002))


@query(f"SELECT word FROM {_A} UNION SELECT word FROM {_B}", "tok")
def vocab_union(spark, sf) -> DataFrame:
    return vocabularies.union(_words(spark, sf, 2001), _words(spark, sf, 2002))


@query(f"SELECT word FROM {_A} EXCEPT SELECT word FROM {_B}", "tok")
def vocab_except(spark, sf) -> DataFrame:
    return vocabularies.difference(_words(spark, sf, 2001), _words(spark, sf, 2002))


@query(f"SELECT count(*) = 0 AS equal FROM ((SELECT word FROM {_A} EXCEPT SELECT word FROM {_B}) UNION ALL (SELECT word FROM {_B} EXCEPT SELECT word FROM {_A}))", "tok")
def vocab_equal(spark, sf) -> DataFrame:
    return vocabularies.equal(_words(spark, sf, 2001), _words(spark, sf, 2002))


@query("SELECT DISTINCT source AS file FROM documents WHERE CAST(substr(source, 4) AS INT) % 3 <> 0")
def resume_manifest(spark, sf) -> DataFrame:
    d = fx.documents(spark, sf)
    return vocabularies.pending(d.select(F.col("source").alias("file")).distinct(), d.where((fx.year() - 2000) % 3 == 0).select(F.col("source").alias("file")), "file")


@query("SELECT ngram, year, CAST(sum(freq) AS BIGINT) AS freq, CAST(sum(doc) AS BIGINT) AS doc FROM ng1 GROUP BY 1, 2", "ng1")
def incremental_ingest(spark, sf) -> DataFrame:
    """All shards, half of them taken in before."""
    d = fx.ng1(spark, sf).withColumn("file", F.col("year").cast("string"))
    done = d.where("year < 2010")
    read = lambda files: d.join(files, "file", "left_semi").select("ngram", "year", "freq", "doc")
    files = fx.documents(spark, sf).select(fx.year().alias("year")).distinct().withColumn("file", F.col("year").cast("string"))
    out, _ = incremental.ingest(spark, files.select("file"), files.where("year < 2010").select("file"), done.select("ngram", "year", "freq", "doc"), read)
    return out


def _shards(spark, sf) -> str:
    """The raw lines as LZ4 shards, each n-gram's line after one that it replaces."""
    path = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex[:12]}"
    old = F.concat(F.substring_index("value", "\t", 1), F.lit("\t1999,1,1"))
    lines = fx.raw_line(spark, sf).repartition(8, "value").select(F.explode(F.array(old, "value")).alias("value"))
    shards.write_shards(lines, path)
    return path


_NOTHING = "ngram string, year int, freq long, doc long"


@query(f"WITH {_PARSED} SELECT ngram, CAST(year AS INT) AS year, freq, doc FROM n WHERE year IS NOT NULL", "raw_line")
def shard_ingest(spark, sf) -> DataFrame:
    """Shards written by the sink and taken in by the source: the last line of an n-gram wins."""
    done = spark.createDataFrame([], "file string")
    return incremental.ingest_shards(spark, _shards(spark, sf), done, spark.createDataFrame([], _NOTHING), "tagged", seed=3)[0]


@query("SELECT 2 * count(*) AS lines, count(*) AS entries, 0 AS errors FROM raw_line", "raw_line")
def shard_report(spark, sf) -> DataFrame:
    lines = shards.read_shards(spark, _shards(spark, sf))
    return incremental.shard_report(lines, incremental.shard_entries(lines)).agg(*(F.sum(c).alias(c) for c in ("lines", "entries", "errors")))


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf) -> DataFrame:
    return incremental.windowed_events(spark.read.parquet(f"{sf}/events.parquet")).withColumn("total", F.round("total", 4))


# --- weights, grids, names ------------------------------------------------------------------------------

_WEIGHT = "CAST(greatest(1, floor(ln(CAST({} AS DOUBLE) + 1.0) / ln(CAST(10 AS DOUBLE)))) AS INT)"


@query(f"SELECT year, ngram, {_WEIGHT.format('freq')} AS weight FROM ng1", "ng1")
def log_weight(spark, sf) -> DataFrame:
    return fx.ng1(spark, sf).select("year", "ngram", tk.log_weight(F.col("freq")).alias("weight"))


@query(f"SELECT year, CAST(sum({_WEIGHT.format('freq')}) AS BIGINT) AS sentences FROM ng2 GROUP BY 1", "ng2")
def sentence_replicate(spark, sf) -> DataFrame:
    return corpus.replicate(fx.ng2(spark, sf), tk.log_weight(F.col("freq"))).groupBy("year").agg(F.count("*").alias("sentences"))


_YEARS = "(SELECT DISTINCT CAST(1900 + 10 * label AS BIGINT) AS year FROM embeddings) y, (SELECT unnest(['none', 'freq']) AS weight_by) w, (SELECT unnest([100, 200]) AS vector_size) v, (SELECT unnest([5, 10, 15]) AS epochs) e"


def _years(spark, sf) -> list[int]:
    """The years that vectors exist for; a grid's axes are short lists."""
    return [r["year"] for r in fx.emb(spark, sf).select(F.col("year").cast("long").alias("year")).distinct().collect()]


def _grid(spark, sf) -> DataFrame:
    return training.parameter_grid(spark, year=_years(spark, sf), weight_by=["none", "freq"], vector_size=[100, 200], epochs=[5, 10, 15])


@query(f"SELECT year, weight_by, CAST(vector_size AS BIGINT) AS vector_size, CAST(epochs AS BIGINT) AS epochs FROM {_YEARS}")
def param_grid(spark, sf) -> DataFrame:
    """Every combination of parameters for each year of the table."""
    return _grid(spark, sf)


def _names(spark, sf) -> DataFrame:
    """A model's name for every vector of the table: its year, and parameters that vary with vec_id."""
    v, i = spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("vec_id")
    name = training.model_name(1900 + 10 * F.col("label"), F.when(i % 2 == 0, "none").otherwise("doc_freq"), 100 + 100 * (i % 5), 2 + i % 4, i % 7, i % 2, 5 + i % 11)
    return v.select(name.alias("model"))


_NAMES = "(SELECT *, 1900 + 10 * label AS y, concat('w2v_y', 1900 + 10 * label, '_wb', CASE WHEN vec_id % 2 = 0 THEN 'none' ELSE 'doc_freq' END, '_vs', 100 + 100 * (vec_id % 5), '_w', 2 + vec_id % 4, '_mc', vec_id % 7, '_sg', vec_id % 2, '_e', 5 + vec_id % 11, '.kv') AS model FROM embeddings)"


@query(f"SELECT model, CAST(y AS INT) AS year, CASE WHEN vec_id % 2 = 0 THEN 'none' ELSE 'doc_freq' END AS weight_by, CAST(100 + 100 * (vec_id % 5) AS INT) AS vector_size, CAST(2 + vec_id % 4 AS INT) AS window, CAST(vec_id % 7 AS INT) AS min_count, CASE WHEN vec_id % 2 = 1 THEN 'skip-gram' ELSE 'CBOW' END AS approach, CAST(5 + vec_id % 11 AS INT) AS epochs FROM {_NAMES}")
def model_name_parse(spark, sf) -> DataFrame:
    return training.parse_model_name(_names(spark, sf))


@query(f"SELECT CAST(y AS INT) AS year, max(model) AS model FROM {_NAMES} GROUP BY 1")
def latest_model(spark, sf) -> DataFrame:
    return vectors.latest_model(model_name_parse(spark, sf))


# --- vectors ---------------------------------------------------------------------------------------------


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * p[2]))"


def _cos(a: str, b: str) -> str:
    return f"{_dot(a, b)} / (sqrt({_dot(a, a)}) * sqrt({_dot(b, b)}))"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"SELECT year, count(*) AS n_words, bool_and(abs(sqrt({_dot('vec', 'vec')}) - 1) < 1e-5) AS is_normalized FROM emb GROUP BY 1", "emb")
def l2_normalize_check(spark, sf) -> DataFrame:
    tripled = fx.emb(spark, sf).withColumn("vec", F.transform("vec", lambda x: x * F.lit(3).cast("float")))
    return vectors.normalised_report(vectors.normalise(tripled), 1e-5)


@query(f"SELECT a.year, a.word AS word1, b.word AS word2, round({_cos('a.vec', 'b.vec')}, 6) AS similarity FROM emb a JOIN emb b ON a.year = b.year WHERE (a.word, b.word) IN (('w1', 'w2'), ('w3', 'w10'), ('w1', 'w55'))", "emb")
def pair_cosine(spark, sf) -> DataFrame:
    pairs = spark.createDataFrame([("w1", "w2"), ("w3", "w10"), ("w1", "w55")], "word1 string, word2 string")
    return _rounded(vectors.word_cosine(fx.emb(spark, sf), pairs), "similarity")


@query(f"SELECT a.year, round(avg({_dot('a.vec', 'b.vec')}), 6) AS mean, round(stddev_pop({_dot('a.vec', 'b.vec')}), 6) AS sd, count(*) AS shared FROM emb a JOIN emb b ON a.word = b.word WHERE b.year = 1990 GROUP BY 1", "emb")
def model_similarity(spark, sf) -> DataFrame:
    e = fx.emb(spark, sf)
    return _rounded(vectors.model_similarity(e, e.where("year = 1990")), "mean", "sd")


@query("SELECT year, count(*) AS n FROM emb WHERE word IN (SELECT word FROM emb WHERE year = 1900) GROUP BY 1", "emb")
def filter_vocab(spark, sf) -> DataFrame:
    e = fx.emb(spark, sf)
    return vectors.filter_vocabulary(e, e.where("year = 1900")).groupBy("year").agg(F.count("*").alias("n"))


_DRIFT = f"""WITH y AS (SELECT year, lag(year) OVER (ORDER BY year) AS previous FROM (SELECT DISTINCT year FROM emb WHERE year <> 1930)),
d AS (SELECT a.year, {_dot('a.vec', 'b.vec')} AS d FROM emb a JOIN y ON a.year = y.year JOIN emb b ON b.year = y.previous AND b.word = a.word),
m AS (SELECT year, avg(d) AS m, stddev_pop(d) AS sd, count(*) AS shared FROM d GROUP BY 1 HAVING avg(d) <> 0)"""
_Z = "1.959963984540054"


def _gapped(spark, sf) -> DataFrame:
    return fx.emb(spark, sf).where("year <> 1930")


@query(f"{_DRIFT} SELECT year, round(1 - m, 6) AS drift, round(CASE WHEN shared > 1 THEN {_Z} * sd / sqrt(shared) ELSE 0.0 END, 6) AS error, shared FROM m", "emb")
def yearly_drift(spark, sf) -> DataFrame:
    return _rounded(vectors.yearly_drift(_gapped(spark, sf)), "drift", "error")


@query(f"{_DRIFT} SELECT year, round(1 - m, 6) AS drift, round(CASE WHEN shared > 1 THEN (1 - m) / sqrt(shared) ELSE 0.0 END, 6) AS error, shared FROM m", "emb")
def yearly_drift_se(spark, sf) -> DataFrame:
    return _rounded(vectors.yearly_drift(_gapped(spark, sf), error_type="SE"), "drift", "error")


@query(f"""{_DRIFT.replace("b.word = a.word)", "b.word = a.word WHERE a.word = 'w7')")} SELECT year, round(1 - m, 6) AS drift, 0.0 AS error, shared FROM m""", "emb")
def yearly_drift_word(spark, sf) -> DataFrame:
    return _rounded(vectors.yearly_drift(_gapped(spark, sf), word="w7"), "drift", "error")


@query(f"""{_DRIFT}, x AS (SELECT 1 - m AS drift, year, CAST(shared AS DOUBLE) AS x FROM m) SELECT year, round(drift - (SELECT regr_slope(drift, x) FROM x) * x - (SELECT regr_intercept(drift, x) FROM x), 6) AS drift_adjusted FROM x""", "emb")
def drift_ols_residual(spark, sf) -> DataFrame:
    d = vectors.yearly_drift(_gapped(spark, sf))
    return _rounded(vectors.adjusted_drift(d, d.select("year", F.col("shared").alias("n_shared")), "n_shared"), "drift_adjusted").select("year", "drift_adjusted")


@query(f"SELECT a.year, round(avg({_cos('a.vec', 'b.vec')}), 6) AS relatedness FROM emb a JOIN emb b ON a.year = b.year WHERE a.word = 'w5' AND b.word NOT IN ('w5', 'w6', 'w7') GROUP BY 1", "emb")
def relatedness_series(spark, sf) -> DataFrame:
    return _rounded(vectors.relatedness(fx.emb(spark, sf), "w5", ("w6", "w7")), "relatedness")


_T1, _T2, _X1, _X2 = ["w1", "w2", "w3"], ["w4", "w5", "w6"], ["w7", "w8", "w9"], ["w10", "w11", "missing"]


def _list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


@query(f"""WITH s AS (SELECT t.year, t.word IN {_list(_T1)} AS t1, a.word IN {_list(_X1)} AS a1, {_cos('t.vec', 'a.vec')} AS c FROM emb t JOIN emb a ON t.year = a.year WHERE t.word IN {_list(_T1 + _T2)} AND a.word IN {_list(_X1 + _X2)})
SELECT year, round((avg(c) FILTER (WHERE t1 AND a1) - avg(c) FILTER (WHERE t1 AND NOT a1) - avg(c) FILTER (WHERE NOT t1 AND a1) + avg(c) FILTER (WHERE NOT t1 AND NOT a1)) / stddev_samp(c), 6) AS effect, round(stddev_samp(c), 6) AS sd FROM s GROUP BY 1""", "emb")
def weat_by_year(spark, sf) -> DataFrame:
    return _rounded(vectors.weat(fx.emb(spark, sf), (_T1, _T2), (_X1, _X2)), "effect", "sd").select("year", "effect", "sd")


@query()
def weat_permutations(spark, sf) -> DataFrame:
    return vectors.weat(fx.emb(spark, sf), (_T1, _T2), (_X1, _X2), permutations=200, seed=3)


_SPLITS = f"""s AS (SELECT t.year, t.word, t.word IN {_list(_T1)} AS t1, a.word IN {_list(_X1)} AS a1, {_cos('t.vec', 'a.vec')} AS c FROM emb t JOIN emb a ON t.year = a.year WHERE t.word IN {_list(_T1 + _T2)} AND a.word IN {_list(_X1 + _X2)}),
e AS (SELECT year, avg(c) FILTER (WHERE t1 AND a1) - avg(c) FILTER (WHERE t1 AND NOT a1) - avg(c) FILTER (WHERE NOT t1 AND a1) + avg(c) FILTER (WHERE NOT t1 AND NOT a1) AS diff, stddev_samp(c) AS sd FROM s GROUP BY 1),
w AS (SELECT year, word, t1, avg(c) FILTER (WHERE a1) - avg(c) FILTER (WHERE NOT a1) AS d, row_number() OVER (PARTITION BY year ORDER BY word) - 1 AS i FROM s GROUP BY 1, 2, 3),
m AS (SELECT w.year, k, avg(d) FILTER (WHERE (k >> CAST(i AS INT)) & 1 = 1) - avg(d) FILTER (WHERE (k >> CAST(i AS INT)) & 1 = 0) AS pd FROM w, (SELECT unnest(range(0, 64)) AS k) GROUP BY 1, 2
  HAVING count(*) FILTER (WHERE (k >> CAST(i AS INT)) & 1 = 1) = count(*) FILTER (WHERE t1))"""


@query(f"WITH {_SPLITS} SELECT e.year, round(any_value(diff / sd), 6) AS effect, round(any_value(sd), 6) AS sd, round(avg(CASE WHEN pd >= diff - 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS p FROM e JOIN m ON m.year = e.year GROUP BY 1", "emb")
def weat_all_splits(spark, sf) -> DataFrame:
    return _rounded(vectors.weat_exact(fx.emb(spark, sf), (_T1, _T2), (_X1, _X2)), "effect", "sd", "p")


@query(f"WITH {_SPLITS}, k AS (SELECT year, diff / sd AS effect, CASE WHEN year <> 1950 THEN sd END AS sd FROM e) SELECT CAST(year AS DOUBLE) AS centre, round(effect, 6) AS effect, round({_Z} * coalesce(sd, avg(sd) OVER ()), 6) AS half_width FROM k", "emb")
def weat_band(spark, sf) -> DataFrame:
    """The confidence band of the association series; one year's deviation is missing and takes the mean of the others."""
    scores = vectors.weat(fx.emb(spark, sf), (_T1, _T2), (_X1, _X2)).withColumn("sd", F.when(F.col("year") == 1950, F.lit(float("nan"))).otherwise(F.col("sd")))
    return _rounded(vectors.association_band(scores), "effect", "half_width")


_SPEAR = f"""p AS (SELECT a.year, CAST(substr(a.word, 2) AS INT) % 7 AS human, {_cos('a.vec', 'b.vec')} AS model FROM emb a JOIN emb b ON a.year = b.year AND CAST(substr(b.word, 2) AS INT) = CAST(substr(a.word, 2) AS INT) + 1 WHERE CAST(substr(a.word, 2) AS INT) <= 20),
r AS (SELECT year, rank() OVER (PARTITION BY year ORDER BY human) + (count(*) OVER (PARTITION BY year, human) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY year ORDER BY model) + (count(*) OVER (PARTITION BY year, model) - 1) / 2.0 AS rb FROM p)"""


@query(f"WITH {_SPEAR} SELECT year, round(corr(ra, rb), 6) AS similarity_score, count(*) AS n_pairs FROM r GROUP BY 1", "emb")
def spearman_eval(spark, sf) -> DataFrame:
    human = spark.range(1, 21).select(F.concat(F.lit("w"), F.col("id")).alias("word1"), F.concat(F.lit("w"), F.col("id") + 1).alias("word2"), (F.col("id") % 7).alias("human"))
    sims = vectors.word_cosine(fx.emb(spark, sf), human.select("word1", "word2")).join(human, ["word1", "word2"])
    return _rounded(vectors.spearman(sims, "human", "similarity", "year"), "similarity_score")


_U = f"list_transform(vec, lambda x: CAST(CAST(x AS DOUBLE) / sqrt({_dot('vec', 'vec')}) AS FLOAT))"


@query("""WITH q AS (SELECT * FROM (VALUES ('w1', 'w2', 'w3', 'w4'), ('w5', 'w6', 'w7', 'w8'), ('w9', 'w10', 'w11', 'w12'), ('w2', 'w1', 'w3', 'w9')) t(a, b, c, d)),
g AS (SELECT a.year, q.a, q.b, q.c, q.d, list_transform(list_zip(a.vec, b.vec, c.vec), lambda p: CAST(p[2] AS DOUBLE) - p[1] + p[3]) AS g FROM q JOIN emb a ON a.word = q.a JOIN emb b ON b.word = q.b AND b.year = a.year JOIN emb c ON c.word = q.c AND c.year = a.year JOIN emb d ON d.word = q.d AND d.year = a.year),
s AS (SELECT g.year, a, b, c, d, e.word, row_number() OVER (PARTITION BY g.year, a, b, c, d ORDER BY """ + _dot("g.g", "e.vec") + """ DESC) AS r FROM g JOIN emb e ON e.year = g.year WHERE e.word NOT IN (a, b, c))
SELECT year, avg(CASE WHEN word = d THEN 1.0 ELSE 0.0 END) AS analogy_score, count(*) AS n_questions FROM s WHERE r = 1 GROUP BY 1""", "emb")
def analogy_eval(spark, sf) -> DataFrame:
    q = spark.createDataFrame([("w1", "w2", "w3", "w4"), ("w5", "w6", "w7", "w8"), ("w9", "w10", "w11", "w12"), ("w2", "w1", "w3", "w9")], "a string, b string, c string, d string")
    return vectors.analogy(fx.emb(spark, sf), q)


# --- series ------------------------------------------------------------------------------------------------


def _orders(spark, sf) -> DataFrame:
    """A monthly series: year counts months here."""
    month = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")
    return spark.read.parquet(f"{sf}/orders.parquet").groupBy(month.cast("int").alias("year")).agg(F.round(F.avg("o_totalprice"), 2).alias("value"))


_ORDERS = "s AS (SELECT CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS INT) AS year, round(avg(o_totalprice), 2) AS value FROM orders GROUP BY 1)"


@query(f"""WITH {_ORDERS.replace('s AS', 'o AS', 1)}, s AS (SELECT * FROM o WHERE year % 5 <> 0), a AS (SELECT CAST(unnest(range(0, 101)) AS INT) AS year), j AS (SELECT a.year, s.value, (SELECT max(year) FROM s p WHERE p.year <= a.year) AS y0, (SELECT min(year) FROM s p WHERE p.year >= a.year) AS y1 FROM a LEFT JOIN s ON a.year = s.year)
SELECT j.year, round(CASE WHEN y0 IS NULL THEN n.value WHEN y1 IS NULL OR y0 = y1 THEN p.value ELSE p.value + (n.value - p.value) * (j.year - y0) / (y1 - y0) END, 4) AS value FROM j LEFT JOIN s p ON p.year = y0 LEFT JOIN s n ON n.year = y1""")
def interpolate_series(spark, sf) -> DataFrame:
    """The series with gaps: interpolation fills them."""
    return series.interpolate(_orders(spark, sf).where("year % 5 <> 0"), 0, 100).withColumn("value", F.round("value", 4))


@query(f"WITH {_ORDERS}, r AS (SELECT *, (row_number() OVER (ORDER BY year) - 1) // 4 AS k FROM s) SELECT avg(year) AS centre, round(avg(value), 4) AS value FROM r GROUP BY k")
def chunk_mean(spark, sf) -> DataFrame:
    return series.chunk_mean(_orders(spark, sf), 4).withColumn("value", F.round("value", 4))


_KERNEL = "(VALUES " + ", ".join(f"({k}, CAST({c!r} AS DOUBLE))" for k, c in series.gaussian_weights(2.0)) + ") w(k, c)"
_POS = "p AS (SELECT year, value, row_number() OVER (ORDER BY year) - 1 AS i, count(*) OVER () AS n FROM s)"


@query(f"""WITH {_ORDERS}, {_POS}, x AS (SELECT p.year, w.c, ((p.i + w.k) % (2 * p.n) + 2 * p.n) % (2 * p.n) AS a, p.n FROM p, {_KERNEL})
SELECT x.year, round(sum(x.c * q.value), 4) AS value FROM x JOIN p q ON q.i = CASE WHEN a < x.n THEN a ELSE 2 * x.n - 1 - a END GROUP BY 1""")
def gaussian_smooth(spark, sf) -> DataFrame:
    return series.gaussian(_orders(spark, sf), 2.0).withColumn("value", F.round("value", 4))


_SAVGOL = "(VALUES " + ", ".join(f"({r}, {k}, CAST({c!r} AS DOUBLE))" for r, row in enumerate(series.savgol_weights()) for k, c in enumerate(row)) + ") w(r, k, c)"


@query(f"""WITH {_ORDERS}, {_POS}, x AS (SELECT year, i, greatest(0, least(i - 5, n - 11)) AS b, (max(year) OVER () - min(year) OVER ()) / CAST(n - 1 AS DOUBLE) AS step FROM p)
SELECT x.year, round(sum(w.c * q.value) / any_value(x.step), 4) AS value FROM x JOIN {_SAVGOL} ON w.r = x.i - x.b JOIN p q ON q.i = x.b + w.k GROUP BY 1""")
def savgol_derivative(spark, sf) -> DataFrame:
    return series.savgol_derivative(_orders(spark, sf)).withColumn("value", F.round("value", 4))


@query("SELECT o_orderpriority, o_orderstatus, round(avg(o_totalprice), 4) AS mean, count(o_totalprice) AS n FROM orders GROUP BY 1, 2")
def metric_group_mean(spark, sf) -> DataFrame:
    return series.group_mean(spark.read.parquet(f"{sf}/orders.parquet"), "o_totalprice", "o_orderpriority", "o_orderstatus").withColumn("mean", F.round("mean", 4))


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("SELECT CAST(year(o_orderdate) AS INT) AS year, " + ", ".join(f"round(coalesce(avg(o_totalprice) FILTER (WHERE o_orderpriority = '{p}' AND o_custkey % 40 = year(o_orderdate) % 40), 0), 4) AS p{p[0]}" for p in _PRIORITIES) + " FROM orders WHERE o_custkey % 40 = year(o_orderdate) % 40 OR o_orderpriority = '1-URGENT' GROUP BY 1")
def metric_grid(spark, sf) -> DataFrame:
    """Mean prices of years by priorities as a grid; pairs that don't occur are 0."""
    o = spark.read.parquet(f"{sf}/orders.parquet").withColumn("year", F.year("o_orderdate"))
    own = F.col("o_custkey") % 40 == F.col("year") % 40
    rows = o.where(own | (F.col("o_orderpriority") == "1-URGENT")).withColumn("price", F.when(own, F.col("o_totalprice")))
    out = series.grid(rows, "price", "year", "o_orderpriority", _PRIORITIES)
    return out.select("year", *(F.round(F.col(f"`{p}`"), 4).alias(f"p{p[0]}") for p in _PRIORITIES))


# --- training and alignment: checked by their own invariants -------------------------------------------------


@query()
def procrustes_align(spark, sf) -> DataFrame:
    return alignment.align(vectors.normalise(fx.emb(spark, sf)), 1990).select("year", "word", F.round(norm(F.col("vec")), 4).alias("length"))


@query()
def alignment_report(spark, sf) -> DataFrame:
    return alignment.report(fx.emb(spark, sf), 1990)


@query("""SELECT a.year, CAST(i - 1 AS INT) AS i, CAST(j - 1 AS INT) AS j, round(sum(CAST(a.vec[i] AS DOUBLE) * b.vec[j]), 6) AS value
FROM emb a JOIN emb b ON b.word = a.word AND b.year = 1990, (SELECT unnest(range(1, 65)) AS i), (SELECT unnest(range(1, 65)) AS j) GROUP BY 1, 2, 3""", "emb")
def alignment_covariance(spark, sf) -> DataFrame:
    """What rotations come from: one sum of outer products a year."""
    return _rounded(alignment.covariance_cells(alignment.covariances(fx.emb(spark, sf), 1990)), "value")


@query(f"""SELECT a.year, count(*) AS shared, round(avg(sqrt({_dot('a.vec', 'a.vec')})), 6) AS norm_mean, round(sqrt(greatest(0, sum({_dot('a.vec', 'a.vec')}) + sum({_dot('b.vec', 'b.vec')}) - 2 * sum({_dot('a.vec', 'b.vec')}))), 5) AS residual_before,
  any_value(n.n) = count(*) AND (SELECT count(*) FROM emb WHERE year = 1990) = count(*) AS vocab_match
FROM emb a JOIN emb b ON b.word = a.word AND b.year = 1990 JOIN (SELECT year, count(*) AS n FROM emb GROUP BY 1) n ON n.year = a.year GROUP BY 1""", "emb")
def alignment_shared(spark, sf) -> DataFrame:
    """The parts of the report that SQL can express."""
    out = alignment.report(fx.emb(spark, sf), 1990).select("year", "shared", "norm_mean", F.round("residual_before", 5).alias("residual_before"), "vocab_match")
    return _rounded(out, "norm_mean")


@query()
def w2v_train(spark, sf) -> DataFrame:
    pairs = training.cooccurrences(fx.ng2(spark, sf), window=1, weight_by="freq", min_count=5)
    return training.train(pairs, vector_size=16, approach="skip-gram", epochs=2)


@query()
def w2v_train_cbow(spark, sf) -> DataFrame:
    windows = training.context_windows(fx.ng2(spark, sf), window=1, weight_by="freq", min_count=5)
    return training.train(windows, vector_size=16, approach="CBOW", epochs=2)


@query()
def w2v_train_blocks(spark, sf) -> DataFrame:
    """Every year by nine blocks, three at a time."""
    pairs = training.cooccurrences(fx.ng2(spark, sf), window=1, weight_by="freq", min_count=5)
    return word2vec.train(pairs, vector_size=16, epochs=2, blocks=3)


_PAIRS = [("w1", "w2", 7.5), ("w3", "w4", 2.0), ("w5", "w6", 9.1), ("w7", "w8", 4.4), ("w9", "w10", 5.0)]
_QUESTIONS = [("w1", "w2", "w3", "w4"), ("w5", "w6", "w7", "w8"), ("w9", "w10", "w11", "w12"), ("w2", "w1", "w3", "w9")]


_VALUES = lambda rows: ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)
_NAME = "concat('w2v_y', year, '_wbfreq_vs64_w1_mc1_sg1_e1.kv')"


@query(f"""WITH pr AS (SELECT * FROM (VALUES {_VALUES(_PAIRS)}) t(word1, word2, score)), qu AS (SELECT * FROM (VALUES {_VALUES(_QUESTIONS)}) t(a, b, c, d)),
p AS (SELECT a.year, score AS human, {_cos('a.vec', 'b.vec')} AS model FROM pr JOIN emb a ON a.word = word1 JOIN emb b ON b.word = word2 AND b.year = a.year),
r AS (SELECT year, rank() OVER (PARTITION BY year ORDER BY human) + (count(*) OVER (PARTITION BY year, human) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY year ORDER BY model) + (count(*) OVER (PARTITION BY year, model) - 1) / 2.0 AS rb FROM p),
sp AS (SELECT year, corr(ra, rb) AS similarity_score FROM r GROUP BY 1),
g AS (SELECT a.year, q.*, list_transform(list_zip(a.vec, b.vec, c.vec), lambda p: CAST(p[2] AS DOUBLE) - p[1] + p[3]) AS g FROM qu q JOIN emb a ON a.word = q.a JOIN emb b ON b.word = q.b AND b.year = a.year JOIN emb c ON c.word = q.c AND c.year = a.year JOIN emb d ON d.word = q.d AND d.year = a.year),
s AS (SELECT g.year, d, e.word, row_number() OVER (PARTITION BY g.year, a, b, c, d ORDER BY {_dot('g.g', 'e.vec')} DESC) AS k FROM g JOIN emb e ON e.year = g.year WHERE e.word NOT IN (a, b, c)),
an AS (SELECT year, avg(CASE WHEN word = d THEN 1.0 ELSE 0.0 END) AS analogy_score FROM s WHERE k = 1 GROUP BY 1),
y AS (SELECT DISTINCT year FROM emb)
SELECT {_NAME.replace('year', 'y.year')} AS model, CAST(y.year AS INT) AS year, 'freq' AS weight_by, 64 AS vector_size, 1 AS window, 1 AS min_count, 'skip-gram' AS approach, 1 AS epochs,
  round(CASE WHEN y.year = 1900 THEN 0.5 WHEN y.year <> 1950 THEN similarity_score END, 6) AS similarity_score, round(CASE WHEN y.year = 1900 THEN 0.25 WHEN y.year <> 1950 THEN analogy_score END, 6) AS analogy_score, CASE WHEN y.year = 1950 THEN 'unreadable' END AS error
FROM y LEFT JOIN sp ON sp.year = y.year LEFT JOIN an ON an.year = y.year""", "emb")
def evaluate_models(spark, sf) -> DataFrame:
    """Every year's model scored on word pairs and analogies, with its parameters; one that has a row already keeps it, one that can't be read has no scores."""
    name = F.concat(F.lit("w2v_y"), "year", F.lit("_wbfreq_vs64_w1_mc1_sg1_e1.kv"))
    models = fx.emb(spark, sf).withColumn("model", name)
    pairs = spark.createDataFrame(_PAIRS, "word1 string, word2 string, score double")
    questions = spark.createDataFrame(_QUESTIONS, "a string, b string, c string, d string")
    done = spark.createDataFrame([("w2v_y1900_wbfreq_vs64_w1_mc1_sg1_e1.kv", 0.5, 0.25)], "model string, similarity_score double, analogy_score double")
    failed = models.where("year = 1950").select("model", F.lit("unreadable").alias("error")).distinct()
    scores = evaluation.evaluate(models.where("year <> 1950"), pairs, questions, done)
    return _rounded(evaluation.evaluation_rows(scores, failed), "similarity_score", "analogy_score")
