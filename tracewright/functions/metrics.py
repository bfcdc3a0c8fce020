"""Metrics of length prediction: tolerance accuracy, mean absolute error, aggregate error, losses and bucket classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relative error up to which a prediction counts as right.
TOLERANCE = 0.33


def relative_error(y: Column, p: Column) -> Column:
    return F.abs(p - y) / F.greatest(F.abs(y), F.lit(1e-6))


def regression_metrics(df: DataFrame, y: str, p: str, keys: list[str] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """n, pass_at_1, avg_error, aggregated_error, in one pass with partial aggregation."""
    a, b = F.col(y).cast("double"), F.col(p).cast("double")
    return df.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(relative_error(a, b) <= tolerance, 1.0).otherwise(0.0)).alias("pass_at_1"),
        F.avg(F.abs(b - a)).alias("avg_error"),
        (F.abs(F.sum(b - a)) / F.greatest(F.sum(F.abs(a)), F.lit(1e-6))).alias("aggregated_error"),
    )


def losses(df: DataFrame, y: str, p: str, delta: float = 0.1, share: float = 0.2) -> DataFrame:
    """Huber loss of the relative error, aggregate bias, and their weighted total."""
    a, b = F.col(y).cast("double"), F.col(p).cast("double")
    rel = relative_error(a, b)
    q = F.least(rel, F.lit(delta))
    out = df.agg(F.avg(0.5 * q * q + delta * (rel - q)).alias("huber"), (F.abs(F.sum(b - a)) / F.greatest(F.sum(F.abs(a)), F.lit(1e-6))).alias("bias"))
    return out.withColumn("total", F.col("huber") + share * F.col("bias"))


def described(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """count, mean, std (sample), min, quartiles (interpolated), max of a column's values that aren't null, within keys."""
    x = F.col(value).cast("double")
    q = {f"q{int(100 * p)}": F.percentile(x, F.lit(p)) for p in (0.25, 0.5, 0.75)}
    cols = {"n": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x), "low": F.min(x), **q, "high": F.max(x)}
    return df.groupBy(*(keys or [])).agg(*[c.alias(n) for n, c in cols.items()])
