"""Correlation, difference statistics and histograms as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pearson(df: DataFrame, x: str, y: str, count: str = "n", name: str = "corr") -> DataFrame:
    """One row (n, corr); corr is 0 below two rows, for constant columns and for NaN or infinite input."""
    a = df.agg(F.count("*").alias("n"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"), F.covar_pop(x, y).alias("cv"))
    ok = (F.col("n") >= 2) & ~F.isnan("sx") & ~F.isnan("sy") & (F.col("sx") >= 1e-15) & (F.col("sy") >= 1e-15)
    return a.select(F.col("n").alias(count), F.coalesce(F.when(ok, F.col("cv") / (F.col("sx") * F.col("sy"))), F.lit(0.0)).alias(name))


def abs_diff(x: str, y: str) -> Column:
    return F.abs(F.col(x) - F.col(y))


def diff_stats(df: DataFrame, value: str) -> DataFrame:
    """One row: n, mean, stddev (of a sample, 0 for one row), rmse, min, max."""
    v = F.col(value)
    return df.agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("stddev"), F.sqrt(F.avg(v * v)).alias("rmse"), F.min(v).alias("min"), F.max(v).alias("max")
    )


def bins(df: DataFrame, value: str, n: int) -> DataFrame:
    """Counts of n equal bins from least to largest value (bin, lo, hi, n); the last bin holds its right edge. Empty bins count 0."""
    bound = df.agg(F.min(value).alias("a"), F.max(value).alias("b")).where(F.col("a").isNotNull())
    flat = F.col("a") == F.col("b")
    bound = bound.select(F.when(flat, F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(flat, F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    v, a, b = F.col(value), F.col("a"), F.col("b")
    step = (b - a) / n

    def edge(i: Column) -> Column:
        return F.when(i == n, b).otherwise(i * step + a)

    i0 = F.least(F.floor((v - a) / (b - a) * n), F.lit(n - 1))
    placed = df.where(v.isNotNull()).join(F.broadcast(bound)).select(v, a, b, i0.alias("i0"))  # bound is one row
    i = F.when(v < edge(F.col("i0")), F.col("i0") - 1).when((v >= edge(F.col("i0") + 1)) & (F.col("i0") != n - 1), F.col("i0") + 1).otherwise(F.col("i0"))
    counts = placed.groupBy(i.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    frame = bound.select(a, b, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    return frame.join(counts, "bin", "left").select("bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def band(center: Column, mean: Column, spread: Column) -> Column:
    """How far a bin's centre lies from the mean in spreads: 1s, 2s, 3s or beyond."""
    d = F.abs(center - mean)
    return F.when((spread == 0) | (d <= spread), F.lit("1s")).when(d <= 2 * spread, F.lit("2s")).when(d <= 3 * spread, F.lit("3s")).otherwise(F.lit("beyond"))


def diff_histogram(df: DataFrame, value: str, n: int = 100, metric: str = "stddev") -> DataFrame:
    """bins with the band of each bin; metric is stddev or rmse."""
    stats = diff_stats(df, value).select("mean", F.col(metric).alias("spread"))
    b = bins(df, value, n).join(F.broadcast(stats))  # stats is one row
    return b.select("bin", "lo", "hi", "n", band((F.col("lo") + F.col("hi")) / 2, F.col("mean"), F.col("spread")).alias("band"))


def axis_range(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (lo, hi) over both columns with a margin of 5 %; a span of 0 counts as 1."""
    r = df.agg(F.min(F.least(x, y)).alias("lo"), F.max(F.greatest(x, y)).alias("hi"))
    span = F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise(F.col("hi") - F.col("lo"))
    return r.select((F.col("lo") - 0.05 * span).alias("lo"), (F.col("hi") + 0.05 * span).alias("hi"))


def side(ref: str, fit: str) -> Column:
    """red above the diagonal, blue on it and below."""
    return F.when(F.col(fit) > F.col(ref), F.lit("red")).otherwise(F.lit("blue"))
