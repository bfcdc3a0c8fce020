"""Samples and splits. The order is md5(seed || key), the same in any engine; sizes and group invariants are those of a seeded shuffle."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(str(seed)), key.cast("string")))


def group_ranks(df: DataFrame, group: str, seed: int) -> DataFrame:
    """group, rows, rank from 0 in shuffled order, rows of the groups before. A null group is one too. Ranks come in two levels, by the leading digits of the
    hash and within, so that no task holds all groups; there are a few times as many first digits as shuffle partitions."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digits = max(2, len(f"{4 * parts:x}"))
    h = shuffled(F.coalesce(F.col(group).cast("string"), F.lit("")), seed)
    groups = df.groupBy(group).agg(F.count(F.lit(1)).alias("rows")).withColumn("h", h).withColumn("b", F.substring("h", 1, digits))
    sizes = groups.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("r"))
    before = Window.partitionBy(F.lit(0)).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # 16 rows for each possible leading digit but one
    starts = sizes.select("b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("r").over(before), F.lit(0)).alias("r0"))
    w = Window.partitionBy("b").orderBy("h", group)
    inner = F.coalesce(F.sum("rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = groups.withColumns({"i": F.row_number().over(w) - 1, "r": inner}).join(F.broadcast(starts), "b")
    return ranked.select(group, "rows", (F.col("n0") + F.col("i")).alias("rank"), (F.col("r0") + F.col("r")).alias("rows_before"))


def holdout(df: DataFrame, group: str, ratio: float, seed: int) -> DataFrame:
    """group, is_validation: the first max(1, floor(groups * ratio)) groups."""
    ranks = group_ranks(df, group, seed)
    n = ranks.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * ratio)).alias("n_valid"))
    return ranks.crossJoin(F.broadcast(n)).select(group, (F.col("rank") < F.col("n_valid")).alias("is_validation"))  # one row: a scalar


def kfold(df: DataFrame, group: str, folds: int, seed: int) -> DataFrame:
    """group, fold; groups beyond folds * floor(groups / folds) are never validated (fold null)."""
    ranks = group_ranks(df, group, seed)
    n = ranks.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / folds)).alias("size"))
    fold = F.floor(F.col("rank") / F.col("size"))
    return ranks.crossJoin(F.broadcast(n)).select(group, F.when(fold < folds, fold).cast("long").alias("fold"))  # one row: a scalar


def parted(df: DataFrame, groups: DataFrame, group: str, where: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose group meets a condition over groups (one row for each), and all others: of holdout, validation and training."""
    chosen = groups.where(where).select(F.col(group).alias("__g"))
    same = F.col(group).eqNullSafe(F.col("__g"))
    return df.join(chosen, same, "left_semi"), df.join(chosen, same, "left_anti")


def sample_size(n: int, ratio: float = 1.0, most: int | None = None) -> int:
    """Rows to sample of n: by ratio if it is between 0 and 1, `most` at most, one at least."""
    size = int(n * ratio) if 0 < ratio < 1 else n
    return max(1, min(n, size, most or n)) if n else 0


def _filled(sizes: Iterator[tuple], target: int) -> Iterator[tuple]:
    """Of (group, rows) in order, those taken: one that would pass the target is skipped (unless it is the first), and smaller ones may follow."""
    total = 0
    for g, n in sizes:
        if total + n > target and total > 0:
            continue
        yield g, n
        total += n
        if total >= target:
            return


def group_sample(df: DataFrame, group: str, target: int, seed: int, order: list[str]) -> DataFrame:
    """`target` rows: whole groups in shuffled order, skipping those that no longer fit, then single rows of the others in shuffled order. A group that
    comes first and is larger than the target is cut. order: columns that tell rows apart.

    All groups up to the first that doesn't fit are found by their running sums. Which later ones fit is a sequential choice: sizes of those small enough
    stream to the driver in order, and only until the room left, less than the group that didn't fit, is filled."""
    ranks = group_ranks(df, group, seed)
    fits = F.col("rows_before") + F.col("rows") <= target
    n, total = ranks.where(fits).agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    room = target - total
    later = ranks.where((F.col("rank") >= n) & (F.col("rows") <= room)) if n else ranks.where("rank = 0")
    tail = list(_filled(((r[0], r[1]) for r in later.orderBy("rank").select(group, "rows").toLocalIterator()), room)) if room else []
    more = df.sparkSession.createDataFrame([(g,) for g, _ in tail], ranks.select(group).schema)
    inside, outside = parted(df, ranks.where(fits).select(group).unionByName(more), group, "true")
    total += sum(k for _, k in tail)
    mixed = shuffled(F.concat_ws("|", *order), seed)
    if total > target:
        return inside.orderBy(mixed, *order).limit(target)
    return inside if total == target else inside.unionByName(outside.orderBy(mixed, *order).limit(target - total))


def uniform_sample(df: DataFrame, key: str, target: int, seed: int) -> DataFrame:
    return df.orderBy(shuffled(F.col(key), seed), key).limit(target)
