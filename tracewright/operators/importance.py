"""Leave-one-out importance over an ablation log: one row for each (key, variant), variant 'base' or 'drop_<k>'."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def grouped(df: DataFrame, keys: list[str], order: str, variant: str = "variant", base: str = "last") -> DataFrame:
    """One row for each key and variant: of repeated steps the last in the order, of repeated base rows the last or the first."""
    rank = F.struct(F.col(order), F.xxhash64(*[F.col(c) for c in df.columns]))
    pick = F.when(F.col(variant) == "base", F.lit(base == "first")).otherwise(F.lit(False))
    row = F.struct(*df.columns)
    best = df.groupBy(*keys, variant).agg(F.when(F.first(pick), F.min_by(row, rank)).otherwise(F.max_by(row, rank)).alias("__row"))
    return best.select("__row.*")


def base_value(keys: list[str], variant: str, value: str) -> Column:
    """The base row's value, beside every row of its key."""
    return F.max(F.when(F.col(variant) == "base", F.col(value))).over(Window.partitionBy(*keys))


def dense(df: DataFrame, keys: list[str], step: str, value: str, out: str = "vector") -> DataFrame:
    """keys and the values of steps 0 to the largest, 0 for steps that are missing."""
    at = df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col(step).cast("int").alias("k"), F.col(value).alias("v")))).alias("__m"), F.max(F.col(step).cast("int")).alias("__n"))
    return at.select(*keys, F.transform(F.sequence(F.lit(0), F.col("__n")), lambda i: F.coalesce(F.try_element_at(F.col("__m"), i), F.lit(0.0))).alias(out))


def logp_importance(df: DataFrame, keys: list[str], variant: str = "variant", value: str = "avg_logp") -> DataFrame:
    """raw_delta (base less drop) and importance (not below 0; 0 for what isn't finite) of each drop row. One shuffle, by key."""
    base = base_value(keys, variant, value)
    out = df.withColumn("base_value", base).where(F.col(variant) != "base")
    delta = F.col("base_value") - F.col(value)
    return out.withColumn("raw_delta", delta).withColumn("importance", F.when(finite(delta), F.greatest(delta, F.lit(0.0))).otherwise(0.0))


def normalised(df: DataFrame, keys: list[str], value: str, how: str, out: str) -> DataFrame:
    """none, minmax (all 0 if flat), softmax (shifted by the largest) or zscore (population deviation, 1 if flat), within a key."""
    w, x = Window.partitionBy(*keys), F.col(value)
    if how == "none":
        y = x
    elif how == "minmax":
        lo, hi = F.min(x).over(w), F.max(x).over(w)
        y = F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(0.0)
    elif how == "softmax":
        top = df.withColumn("__e", F.exp(x - F.max(x).over(w)))
        return top.withColumn(out, F.col("__e") / F.sum("__e").over(w)).drop("__e")
    elif how == "zscore":
        sd = F.stddev_pop(x).over(w)
        y = (x - F.avg(x).over(w)) / F.when(sd > 0, sd).otherwise(1.0)
    else:
        raise ValueError(f"unknown normalisation {how}")
    return df.withColumn(out, y)


def binary_importance(df: DataFrame, keys: list[str], variant: str = "variant", match: str = "is_match") -> DataFrame:
    """base match less drop match, -1 to 1; keys without a base match and drops without a match are left out."""
    out = df.withColumn("base_is_match", base_value(keys, variant, match)).where(F.col(variant).startswith("drop_"))
    out = out.where(F.col("base_is_match").isNotNull() & F.col(match).isNotNull())
    return out.withColumn("imp_bin", F.col("base_is_match") - F.col(match))


def accuracy_importance(df: DataFrame, keys: list[str], variant: str = "variant", match: str = "is_match") -> DataFrame:
    """As binary_importance but not below 0, with 0 for a drop without a match."""
    out = df.withColumn("base_is_match", base_value(keys, variant, match)).where(F.col(variant) != "base").where(F.col("base_is_match").isNotNull())
    return out.withColumn("acc_importance", F.when(F.col(match).isNull(), 0).otherwise(F.greatest(F.lit(0), F.col("base_is_match") - F.col(match))))
