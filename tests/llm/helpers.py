"""Rows that operators must take: nulls, empty and long texts, ties, repeats, clashing columns."""

import random
import zlib

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *(T.StructField(c, T.StringType()) for c in ("n", "h", "rid", "key", "score", "_row", "word", "length", "kept", "m")),
])


def words(text):
    return (text or "").encode().lower().split()


def odd_rows(seed=1, n=60):
    rng = random.Random(seed)
    vocab = {"en": ["the", "of", "and", "water", "stone", "River", "light", "over"], "de": ["der", "und", "nicht", "über", "straße", "Haus", "schön"]}
    rows = []
    for i in range(n):
        lang = "en" if i % 3 else "de"
        rows.append((i, " ".join(rng.choice(vocab[lang]) + rng.choice(["", "", ".", ","]) for _ in range(rng.randrange(60, 160))), lang, f"src{i % 4}", 0))
    text = rows[0][1]
    rows += [(100, None, "en", None, None), (101, "", None, "src0", 0), (102, " \n\t ", "en", "src0", 0), (103, "word", "en", "src0", 0), (None, "no id here at all", "en", "src0", 0), (None, None, None, None, None), (104, text, "en", "src1", 0), (105, text + " end", "en", "src1", 0), (2, rows[2][1], "en", "src2", 0), (2, "another text of the same id", "de", "src2", 0), (106, "lang word " * 30_000, "en", "src0", 0), (107, "1234 5678 ?!", "de", "src0", 0), (108, "ünï   ΑΣ ß İ \x1c é <|endoftext|> 你好", "de", "src0", 0)]
    return [(*r, *(["x"] * 10)) for r in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def remainder(doc_id, n):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def by_row(rows):
    return sorted(rows, key=repr)
