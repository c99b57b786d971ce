"""Scores of word-vector models: many models at once, those already scored left as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..schema import EVALUATION
from . import vectors as vec
from .training import parse_model_name


def similarity_scores(models: DataFrame, pairs: DataFrame) -> DataFrame:
    """(model, similarity_score, n_pairs): Spearman's correlation of cosines with given scores; pairs with a missing word don't count."""
    of = lambda n: models.select("model", F.col("word").alias(f"word{n}"), F.col("vec").alias(f"v{n}"))
    sims = pairs.join(of(1), "word1").join(of(2), ["model", "word2"]).select("model", "score", cosine(F.col("v1"), F.col("v2")).alias("cosine"))
    return vec.spearman(sims, "score", "cosine", "model")


def analogy_scores(models: DataFrame, questions: DataFrame) -> DataFrame:
    """(model, analogy_score, n_questions); see ``vectors.analogy``, which works on any column that tells models apart."""
    return vec.analogy(models.drop("year").withColumnRenamed("model", "year"), questions).withColumnRenamed("year", "model")


def evaluate(models: DataFrame, pairs: DataFrame, questions: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """(model, similarity_score, analogy_score) of ``models`` (model, word, vec); rows in ``done`` are kept and not made again.

    A model without a pair, or without a question, whose words it all has gets a null there.
    """
    names = models.select("model").distinct()
    if done is not None:
        done = done.select("model", "similarity_score", "analogy_score")
        names, models = names.join(done, "model", "left_anti"), models.join(done, "model", "left_anti")
    out = names.join(similarity_scores(models, pairs).drop("n_pairs"), "model", "left").join(analogy_scores(models, questions).drop("n_questions"), "model", "left")
    out = out.select("model", "similarity_score", "analogy_score")
    return out if done is None else done.unionByName(out)


def evaluation_rows(scores: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """The ten columns of an evaluation table (``schema.EVALUATION``): a model's parameters, from its name, and its scores.

    A model whose name doesn't tell its parameters has no row. ``failed`` (model, error) are models that couldn't be read: they come as
    rows without scores, and ``error`` says why (null for the others), so that nothing that was tried is missing.
    """
    rows = scores.select("model", "similarity_score", "analogy_score", F.lit(None).cast("string").alias("error"))
    if failed is not None:
        none = F.lit(None).cast("double")
        rows = rows.unionByName(failed.select("model", none.alias("similarity_score"), none.alias("analogy_score"), "error"))
    named = parse_model_name(rows.select("model").distinct()).where("year is not null")
    return named.join(rows, "model").select(*EVALUATION.names, *(["error"] if failed is not None else []))


def evaluate_into(path: str, models: DataFrame, pairs: DataFrame, questions: DataFrame, overwrite: bool = False) -> DataFrame:
    """Append the scores of new models to a CSV table of scores, or write it anew; the whole table."""
    spark, kind = models.sparkSession, "model string, similarity_score double, analogy_score double"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = not overwrite and p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    done = spark.read.schema(kind).csv(path, header=True) if there else None
    fresh = evaluate(models, pairs, questions, done)
    if done is not None:
        fresh = fresh.join(done.select("model"), "model", "left_anti")
    fresh.write.mode("append" if there else "overwrite").csv(path, header=True)
    return spark.read.schema(kind).csv(path, header=True)
