"""Column functions on dense vectors; elements are cast to double before they are multiplied."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit(v: Column) -> Column:
    """v / |v|; a zero vector stays as it is."""
    return F.when(norm(v) == 0, v).otherwise(F.transform(v, lambda x: (x.cast("double") / norm(v)).cast("float")))
