"""Series (year, value): interpolation, chunk means, smoothing, derivative. Series are short; many may be worked on at once (``by``)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def interpolate(series: DataFrame, start: int, end: int, by: list[str] | None = None) -> DataFrame:
    """A value for every year start..end: linear between known years, constant beyond them."""
    by = by or []
    groups = series.select(*by).distinct() if by else series.agg(F.lit(1).alias("_one")).drop("_one")
    axis = groups.withColumn("year", F.explode(F.sequence(F.lit(start), F.lit(end)))) if by else series.sparkSession.range(start, end + 1).select(F.col("id").cast("int").alias("year"))
    every = axis.join(series.select(*by, "year").union(axis.select(*by, "year")).distinct(), [*by, "year"], "right").join(series, [*by, "year"], "left")
    w = Window.partitionBy(*by).orderBy("year")
    past, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("value").isNotNull(), F.col("year"))
    out = every.select(*by, "year", "value", F.last(known, True).over(past).alias("y0"), F.last("value", True).over(past).alias("v0"), F.first(known, True).over(ahead).alias("y1"), F.first("value", True).over(ahead).alias("v1"))
    between = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("year") - F.col("y0")) / (F.col("y1") - F.col("y0"))
    value = F.when(F.col("value").isNotNull(), F.col("value")).when(F.col("y0").isNotNull() & F.col("y1").isNotNull(), between).otherwise(F.coalesce("v0", "v1"))
    return out.select(*by, "year", value.alias("value")).where((F.col("year") >= start) & (F.col("year") <= end))


def _by(by: list[str] | None):
    """The window of one series; without ``by`` there is only one, and it is short."""
    return Window.partitionBy(*(by or []))


def chunk_mean(series: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """Means of n neighbouring rows by position: (centre, value); NaN and null values don't count."""
    rows = series.withColumn("k", F.floor((F.row_number().over(_by(by).orderBy("year")) - 1) / n))
    return rows.groupBy(*(by or []), "k").agg(F.avg("year").alias("centre"), F.avg(F.nanvl("value", F.lit(None).cast("double"))).alias("value")).drop("k")


def _kernel(series: DataFrame, weights: list[tuple[int, float]], by: list[str] | None = None) -> DataFrame:
    """Weighted sums of neighbours by position, with the series reflected at both ends (d c b a | a b c d | d c b a)."""
    by = by or []
    pos = series.select(*by, "year", "value", (F.row_number().over(_by(by).orderBy("year")) - 1).alias("i"), F.count("*").over(_by(by)).alias("n"))
    reach = pos.withColumn("w", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(c)).alias("c")) for k, c in weights))))
    at = F.pmod(F.col("i") + F.col("w.k"), 2 * F.col("n"))
    reach = reach.select(*by, "year", "w.c", F.when(at < F.col("n"), at).otherwise(2 * F.col("n") - 1 - at).alias("j"))
    return reach.join(pos.select(*by, F.col("i").alias("j"), F.col("value").alias("v")), [*by, "j"]).groupBy(*by, "year").agg(F.sum(F.col("c") * F.col("v")).alias("value"))


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[tuple[int, float]]:
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [(k, x / sum(w)) for k, x in zip(range(-r, r + 1), w, strict=True)]


def gaussian(series: DataFrame, sigma: float = 2.0, by: list[str] | None = None) -> DataFrame:
    return _kernel(series, gaussian_weights(sigma), by)


def savgol_weights(window: int = 11, order: int = 3, derivative: int = 1) -> list[list[float]]:
    """Row p: weights on the first (for p < half), own or last window's values that give the derivative at offset p - half."""
    import numpy as np

    half = window // 2
    x = np.arange(-half, half + 1)
    fit = np.linalg.pinv(np.vander(x, order + 1, increasing=True))
    out = []
    for p in x:
        powers = [math.perm(k, derivative) * float(p) ** (k - derivative) if k >= derivative else 0.0 for k in range(order + 1)]
        out.append((np.array(powers) @ fit).tolist())
    return out


def savgol_derivative(series: DataFrame, window: int = 11, order: int = 3, by: list[str] | None = None) -> DataFrame:
    """First derivative by local polynomials; at the ends the polynomial of the first or last window. Needs ``window`` rows."""
    half, rows, by = window // 2, savgol_weights(window, order), by or []
    every = _by(by)
    pos = series.select(*by, "year", "value", (F.row_number().over(every.orderBy("year")) - 1).alias("i"), F.count("*").over(every).alias("n"), ((F.max("year").over(every) - F.min("year").over(every)) / (F.count("*").over(every) - 1)).alias("step"))
    begin = F.greatest(F.lit(0), F.least(F.col("i") - half, F.col("n") - window))
    table = F.array(*(F.array(*map(F.lit, r)) for r in rows))
    reach = pos.where(F.col("n") >= window).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(window - 1)))).withColumn("b", begin)
    reach = reach.select(*by, "year", "step", (F.col("b") + F.col("k")).alias("j"), F.get(F.get(table, (F.col("i") - F.col("b")).cast("int")), F.col("k")).alias("c"))
    return reach.join(pos.select(*by, F.col("i").alias("j"), F.col("value").alias("v")), [*by, "j"]).groupBy(*by, "year", "step").agg(F.sum(F.col("c") * F.col("v")).alias("s")).select(*by, "year", (F.col("s") / F.col("step")).alias("value"))


def group_mean(df: DataFrame, metric: str, *by: str) -> DataFrame:
    """What a plot of a metric over 1 to 3 variables shows."""
    return df.groupBy(*by).agg(F.avg(metric).alias("mean"), F.count(metric).alias("n"))


def grid(df: DataFrame, metric: str, row: str, column: str, values: list | None = None) -> DataFrame:
    """Group means of a metric as a grid: a row for each value of ``row``, a column for each of ``column``, 0 where a pair doesn't occur.

    ``values`` names the columns; without it Spark looks for them first.
    """
    means = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row).pivot(column, values).agg(F.avg(metric))
    return means.na.fill(0.0)
