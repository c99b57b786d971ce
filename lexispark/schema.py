"""Schemas of the tables that operators exchange; every read names one."""

from pyspark.sql import types as T

YEAR_COUNT = T.StructType([T.StructField("year", T.IntegerType()), T.StructField("freq", T.LongType()), T.StructField("doc", T.LongType())])
TOKEN = T.StructType([T.StructField("word", T.StringType()), T.StructField("pos", T.StringType())])
#: One row per n-gram and year: what operators work on.
CORPUS = T.StructType([T.StructField("ngram", T.StringType()), *YEAR_COUNT.fields])
#: One row per n-gram, for exchange with systems that nest years.
NESTED = T.StructType([T.StructField("ngram", T.StringType()), T.StructField("freq_tot", T.LongType()), T.StructField("doc_tot", T.LongType()), T.StructField("frequencies", T.ArrayType(YEAR_COUNT))])
VOCABULARY = T.StructType([T.StructField("ngram", T.StringType()), T.StructField("freq_tot", T.LongType()), T.StructField("idx", T.LongType())])
VECTORS = T.StructType([T.StructField("year", T.IntegerType()), T.StructField("word", T.StringType()), T.StructField("vec", T.ArrayType(T.FloatType()))])
EVALUATION = T.StructType([
    T.StructField("model", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("weight_by", T.StringType()), T.StructField("vector_size", T.IntegerType()), T.StructField("window", T.IntegerType()),
    T.StructField("min_count", T.IntegerType()), T.StructField("approach", T.StringType()), T.StructField("epochs", T.IntegerType()), T.StructField("similarity_score", T.DoubleType()), T.StructField("analogy_score", T.DoubleType()),
])

#: Fixed values of the n-gram data: its part-of-speech tags.
TAGS = ("NOUN", "PROPN", "VERB", "ADJ", "ADV", "PRON", "DET", "ADP", "NUM", "CONJ", "X", ".")
