"""Sharding by best-fit-decreasing bin packing.

Groups of equal texts are indivisible. Sorted by size, each enters the bin with the least remaining capacity that still holds it, found in a
balanced tree. Groups of like size are interchangeable, so the packing runs on a histogram of size classes (12 significant bits: fewer than
2**17 classes whatever the data), which is all that reaches the driver; groups are numbered within their class in a distributed way and find their
bin by number. Law: bytes.

Null text: size 1, as an empty one, and in its group. Null doc_id: dealt like any other row. Repeated rows: each gets a slot. Very long texts: whole, a
group like others. Ties: groups of a class are interchangeable; slots follow doc_id, then the text's hash. Extra columns, whatever their names: not read.
Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialise, ranked

SHARDS = 8
#: Leading bits of a size that tell classes apart.
CLASS_BITS = 12
#: Halvings of the interval in which the least capacity is sought.
HALVINGS = 16


class Remaining:
    """Balanced tree (AVL) of (remaining capacity, bin), for the least entry that is not below a size."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: list | None = None  # [key, left, right, height]

    def insert(self, key: tuple) -> None:
        self.root = self._insert(self.root, key)

    def remove(self, key: tuple) -> None:
        self.root = self._remove(self.root, key)

    def ceiling(self, size: float) -> tuple | None:
        node, best = self.root, None
        while node:
            if node[0][0] >= size:
                best, node = node[0], node[1]
            else:
                node = node[2]
        return best

    def _insert(self, node, key):
        if node is None:
            return [key, None, None, 1]
        side = 1 if key < node[0] else 2
        node[side] = self._insert(node[side], key)
        return self._level(node)

    def _remove(self, node, key):
        if key != node[0]:
            side = 1 if key < node[0] else 2
            node[side] = self._remove(node[side], key)
            return self._level(node)
        if node[1] is None or node[2] is None:
            return node[1] or node[2]
        least = node[2]
        while least[1]:
            least = least[1]
        node[0] = least[0]
        node[2] = self._remove(node[2], least[0])
        return self._level(node)

    def _level(self, node):
        high = lambda x: x[3] if x else 0
        node[3] = 1 + max(high(node[1]), high(node[2]))
        lean = high(node[1]) - high(node[2])
        if abs(lean) <= 1:
            return node
        a = 1 if lean > 0 else 2
        child = node[a]
        if high(child[3 - a]) > high(child[a]):
            node[a] = self._turn(child, 3 - a)
        return self._turn(node, a)

    @staticmethod
    def _turn(node, a):
        """The child on side a becomes the parent."""
        up = node[a]
        node[a], up[3 - a] = up[3 - a], node
        for x in (node, up):
            x[3] = 1 + max(x[1][3] if x[1] else 0, x[2][3] if x[2] else 0)
        return up


def best_fit_decreasing(classes: Iterable[tuple[int, float, int]], capacity: float, most: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """classes: (class, size of an item, items). Gives runs (class, first item, end, bin), or None if more than `most` bins are needed. A bin stays the
    tightest that fits as long as it fits at all, so a run of equal items enters it in one step."""
    tree, runs, bins = Remaining(), [], 0
    for name, size, items in sorted(classes, key=lambda x: (-x[1], x[0])):
        at = 0
        while at < items:
            found = tree.ceiling(size)
            if found is None:
                if most is not None and bins == most:
                    return None
                found, bins = (max(capacity, size), bins), bins + 1
            else:
                tree.remove(found)
            fit = min(items - at, max(1, int(found[0] / size)))
            runs.append((name, at, at + fit, found[1]))
            tree.insert((found[0] - fit * size, found[1]))
            at += fit
    return runs


def even_bins(classes: list[tuple[int, float, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """Runs for the least capacity with which best-fit-decreasing needs no more than `shards` bins (multifit)."""
    if not classes:
        return []
    total, largest = sum(s * n for _, s, n in classes), max(s for _, s, _ in classes)
    low = max(total / shards, largest)
    if (runs := best_fit_decreasing(classes, low, shards)) is not None:
        return runs
    high = low + largest
    while (best := best_fit_decreasing(classes, high, shards)) is None:
        high *= 2
    for _ in range(HALVINGS):
        middle = (low + high) / 2
        runs = best_fit_decreasing(classes, middle, shards)
        low, high, best = (middle, high, best) if runs is None else (low, middle, runs)
    return best


def shard(docs: DataFrame, shards: int | None = SHARDS, capacity: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot. With shards: that many, near equal in bytes. With capacity and no shards: as few as best-fit-decreasing
    needs, none above the capacity but those of a single larger group."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("text_key"))
    base = materialise(base, "shard-rows")
    groups = base.groupBy("text_key").agg(F.sum("size").alias("group_size"))
    unit = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.floor(F.log2(F.col("group_size"))) - (CLASS_BITS - 1))).cast("long")
    groups = materialise(groups.withColumn("size_class", (F.col("group_size") / unit).cast("long") * unit), "shard-groups")
    size = F.sum("group_size") / F.count(F.lit(1)) if shards else F.max("group_size").cast("double")  # a fixed capacity must hold the largest of a class
    classes = [(r[0], r[1], r[2]) for r in groups.groupBy("size_class").agg(size, F.count(F.lit(1))).collect()]  # fewer than 2**17 rows
    runs: dict[int, list] = {}
    for c, first, _, to in even_bins(classes, shards) if shards else best_fit_decreasing(classes, capacity):
        runs.setdefault(c, []).append((first, to))
    plan = spark.createDataFrame([(c, sorted(x)) for c, x in runs.items()], "size_class long, runs array<struct<first:long,shard:int>>")
    placed = ranked(groups, ["size_class"], ["text_key"], "n").join(plan, "size_class")
    placed = placed.withColumn("shard", F.element_at(F.filter("runs", lambda x: x["first"] <= F.col("n")), -1)["shard"])
    rows = materialise(base.join(placed.select("text_key", "shard"), "text_key").select("doc_id", "size", "text_crc32", "shard"), "shard-placed")
    return ranked(rows, ["shard"], ["doc_id", "text_crc32", "size"], "slot").select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir)).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
