"""Relations that queries work on, derived from the test tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tokens import tokens
from ..operators.counting import counted, dealt


def year():
    """2000 and the number in source."""
    return F.substring("source", 4, 9).cast("int") + 2000


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def tok(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, lang, year, pos, word: the tokens of documents."""
    return documents(spark, sf).select("doc_id", "lang", year().alias("year"), F.posexplode(tokens(F.col("text"))).alias("pos", "word"))


def summed(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, "ngram").agg(F.sum("n").alias("freq"), F.sum("d").alias("doc"))


def words(spark: SparkSession, sf: str, *keys: str) -> DataFrame:
    """(*keys, ngram, freq, doc) of the words of documents, by year and what else is asked."""
    return summed(counted(documents(spark, sf).withColumn("year", year()), 1, *keys), *keys)


def ng1(spark: SparkSession, sf: str) -> DataFrame:
    """year, ngram, freq, doc of words."""
    return words(spark, sf, "year")


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """year, ngram, freq, doc of pairs of neighbours as batches of texts have them, not summed yet."""
    return counted(documents(spark, sf).withColumn("year", year()), 2, "year").withColumnsRenamed({"n": "freq", "d": "doc"})


def ng2(spark: SparkSession, sf: str) -> DataFrame:
    """The same as ng1 for pairs of neighbours.

    Most pairs are rare, so summing them before the shuffle would hold (and spill) nearly all of a task's pairs: they are dealt by the pair as they
    are, which also serves whatever groups by the pair later.
    """
    return dealt(pairs(spark, sf), documents(spark, sf)).groupBy("year", "ngram").agg(F.sum("freq").alias("freq"), F.sum("doc").alias("doc"))


def raw_line(spark: SparkSession, sf: str) -> DataFrame:
    """Raw lines of tagged unigrams; where the word's length is a multiple of 7, one bad cell is added."""
    tag = F.when(F.length("ngram") % 6 == 0, "NOUN").when(F.length("ngram") % 6 == 1, "VERB").when(F.length("ngram") % 6 == 2, "ADJ").when(F.length("ngram") % 6 == 3, "ADV").when(F.length("ngram") % 6 == 4, "DET").otherwise("X")
    cells = F.transform(F.sort_array(F.collect_list(F.struct("year", "freq", "doc"))), lambda y: F.concat_ws(",", y["year"], y["freq"], y["doc"]))
    rows = ng1(spark, sf).groupBy("ngram").agg(F.array_join(cells, "\t").alias("cells"))
    bad = F.when(F.length("ngram") % 7 == 0, F.lit("\tbad")).otherwise("")
    # As a file's line would be: a value of its own, not an expression that every reader computes again.
    return rows.select(F.explode(F.array(F.concat("ngram", F.lit("_"), tag, F.lit("\t"), "cells", bad))).alias("value"))


def emb(spark: SparkSession, sf: str) -> DataFrame:
    """year, word, vec: words shared by years."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    word = F.concat(F.lit("w"), F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("string"))
    return e.select((F.lit(1900) + 10 * F.col("label")).alias("year"), word.alias("word"), F.col("embedding").alias("vec"))


SQL = {
    "tok": r"""tok AS (SELECT doc_id, lang, 2000 + CAST(substr(source, 4) AS INT) AS year, CAST(g - 1 AS INT) AS pos, toks[g] AS word
  FROM (SELECT doc_id, lang, source, toks, unnest(range(1, len(toks) + 1)) AS g
        FROM (SELECT *, list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '') AS toks FROM documents)))""",
    "ng1": "ng1 AS (SELECT year, word AS ngram, count(*) AS freq, count(DISTINCT doc_id) AS doc FROM tok GROUP BY year, word)",
    "ng2": """ng2 AS (SELECT year, concat(word, ' ', nxt) AS ngram, count(*) AS freq, count(DISTINCT doc_id) AS doc
  FROM (SELECT doc_id, year, word, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM tok) WHERE nxt IS NOT NULL GROUP BY 1, 2)""",
    "raw_line": """raw_line AS (SELECT concat(ngram, '_', CASE length(ngram) % 6 WHEN 0 THEN 'NOUN' WHEN 1 THEN 'VERB' WHEN 2 THEN 'ADJ' WHEN 3 THEN 'ADV' WHEN 4 THEN 'DET' ELSE 'X' END, chr(9),
    string_agg(concat(year, ',', freq, ',', doc), chr(9) ORDER BY year), CASE WHEN length(ngram) % 7 = 0 THEN concat(chr(9), 'bad') ELSE '' END) AS value FROM ng1 GROUP BY ngram)""",
    "emb": "emb AS (SELECT 1900 + 10 * label AS year, concat('w', row_number() OVER (PARTITION BY label ORDER BY vec_id)) AS word, embedding AS vec FROM embeddings)",
}


def with_sql(body: str, *names: str) -> str:
    """A query over some of the relations above, with what they need."""
    need = {"ng1": ["tok"], "ng2": ["tok"], "raw_line": ["tok", "ng1"]}
    order = [n for n in SQL if n in names or any(n in need.get(m, ()) for m in names)]
    own = ", ".join(SQL[n] for n in order)
    body = body.strip()
    own = f"RECURSIVE {own}" if "UNION ALL" in body else own
    return f"WITH {own}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {own} {body}"
