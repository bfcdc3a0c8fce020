"""Document fingerprints from closed syncmers, in DataFrame functions alone.

A text is a sequence of symbols: words [^\\x20\\x09-\\x0D]+, runs of over PIECE characters cut into pieces. A k-mer of K symbols is picked if the least hash among
its inner S-mers stands at its first or last place. Whether a k-mer is picked depends on the k-mer alone, so equal passages pick equal anchors wherever
they stand (within a run of over PIECE characters without a blank, only at equal distances from its start). anchors gives every pick with its position. The
fingerprint is the KEPT least hashes of the picked k-mers in hexadecimal; likeness is the share of the union's KEPT least hashes that both hold. A text of
fewer than K symbols, or with none picked, has the hash of its whole sequence.

The next document is found by dealing rows into ranges of doc_id, in each of which the first row of the next range stands as a guard: one shuffle.

Null text: as an empty one, with an empty fingerprint; two empty fingerprints are alike (1), an empty and another are not (0). Null doc_id: sorts first.
Repeated rows: ordered by text hash, each its own row. Very long texts: whole. A single document is its own next one. Extra columns, whatever their names: not
read. Empty table: no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents

K, S, PIECE, KEPT = 6, 2, 12, 64
#: Rows of a range of ids, and the most ranges.
RANGE_ROWS, RANGES = 2048, 1 << 16


def with_picks(df: DataFrame, text: str, h: str, at: str) -> DataFrame:
    """df with the hashes of a text's symbols and the places (from 1) of its picked k-mers, null for fewer than K symbols. Each step is a column of its own,
    so that nothing is worked out twice."""
    m = f"{h}_m"
    df = df.withColumn(h, F.transform(F.regexp_extract_all(text, F.lit(rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"), F.lit(0)), lambda x: F.xxhash64(x)))
    n = F.size(h)
    df = df.withColumn(m, F.when(n >= S, F.zip_with(F.slice(h, 1, n - 1), F.slice(h, 2, n - 1), lambda a, b: F.xxhash64(a, b))))
    inner = K - S + 1
    edge = lambda i: F.array_min(F.slice(m, i, inner)) == F.least(F.get(m, i - 1), F.get(m, i + (inner - 2)))
    return df.withColumn(at, F.when(n >= K, F.filter(F.sequence(F.lit(1), n - (K - 1)), edge))).drop(m)


def with_sketch(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the sorted least hashes of the picked k-mers of a text column."""
    h, at = f"__h_{out}", f"__at_{out}"
    df = with_picks(df, text, h, at)
    picked = F.transform(at, lambda i: F.xxhash64(F.slice(h, i, K)))
    df = df.withColumn(out, F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(at) > 0, F.slice(F.array_sort(F.array_distinct(picked)), 1, KEPT)).otherwise(F.array(F.xxhash64(h))))
    return df.drop(h, at)


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, position (of the k-mer's first symbol, from 0) and hash of every picked k-mer of every whole text: a row for each, for positional matching by
    joins on the hash. Nothing is left out, however long the text."""
    rows = with_picks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), "text", "h", "at")
    return rows.select("doc_id", "h", F.explode("at").alias("i")).select("doc_id", (F.col("i") - 1).cast("long").alias("position"), F.xxhash64(F.slice("h", F.col("i"), K)).alias("hash"))


def likeness(a: str, b: str) -> Column:
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, KEPT)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.greatest(F.size(union), F.lit(1)))


def shown(sketch: str) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def range_of(col: Column, bounds: list[int]) -> Column:
    """Number of bounds that are not above col, found in two steps; 0 for null."""
    if not bounds:
        return F.lit(0)
    g = math.isqrt(len(bounds)) + 1
    groups = [bounds[i : i + g] for i in range(0, len(bounds), g)]
    longs = lambda x: F.array(*map(F.lit, x)).cast("array<bigint>")
    coarse = F.size(F.filter(longs([x[0] for x in groups]), lambda x: x <= col))
    fine = F.size(F.filter(F.get(F.array(*map(longs, groups)), F.greatest(coarse - 1, F.lit(0))), lambda x: x <= col))
    return F.when(col.isNull(), 0).otherwise(F.greatest(coarse - 1, F.lit(0)) * g + fine)


def with_next(df: DataFrame, id_col: str, payload: list[str], prepare=lambda x: x) -> DataFrame:
    """prepare(df) with next_<name> of each payload column: that of the row with the next id, and after the last, of the first. df has a column tie.
    prepare adds columns row by row; it runs once, after the guards are in."""
    spark = df.sparkSession
    n = df.select(id_col).count()
    parts = min(RANGES, n // RANGE_ROWS)
    bounds: list[int] = []
    if parts > 1:
        found = df.agg(F.percentile_approx(id_col, [i / parts for i in range(1, parts)], max(10_000, 4 * parts))).first()[0] or []
        bounds = sorted(set(found))
    dealt = df.withColumn("__range", range_of(F.col(id_col), bounds).cast("int")).withColumn("__guard", F.lit(0))
    heads = sorted((r["__range"], r["h"]["i"], r["h"]["tie"]) for r in dealt.groupBy("__range").agg(F.min(F.struct(F.col(id_col).alias("i"), "tie")).alias("h")).collect())  # a row for each range
    if not heads:
        return prepare(df).select("*", *[F.col(p).alias(f"next_{p}") for p in payload])
    guards = spark.createDataFrame([(heads[i - 1][0], *heads[i][1:]) for i in range(len(heads))], "__to int, __id long, __tie long")
    first = df.join(F.broadcast(guards), F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("tie") == F.col("__tie")))
    first = first.withColumn("__range", F.col("__to")).withColumn("__guard", F.lit(1)).select(dealt.columns)
    order = Window.partitionBy("__range").orderBy("__guard", F.col(id_col).asc_nulls_first(), "tie")
    out = prepare(dealt.unionByName(first)).withColumns({f"next_{p}": F.lead(p).over(order) for p in payload})
    return out.where("__guard = 0").drop("__range", "__guard")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = with_next(rows, "doc_id", ["text", "sketch"], lambda x: with_sketch(x, "text", "sketch")).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256)).select("doc_id", "n_chars", "edited", "edited_sha256", "sketch", "next_sketch")
    rows = with_sketch(rows, "edited", "edited_sketch")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", shown("sketch").alias("fingerprint"), shown("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").cast("double").alias("near_edited"), likeness("sketch", "next_sketch").cast("double").alias("near_next"),
    )


def op2_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
