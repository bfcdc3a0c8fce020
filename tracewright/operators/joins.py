"""Joins of the record pipelines: last-wins lookups, prioritised fallback keys, key intersections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def last_wins_join(probe: DataFrame, build: DataFrame, keys: list[str], order: list[Column], how: str = "inner") -> DataFrame:
    """order runs from the row that wins on."""
    return probe.join(one_per_key(build, keys, order), keys, how)


def fallback_join(records: DataFrame, build: DataFrame, row: str, candidates: list[tuple[Column, Column]], value: str, order: list[Column]) -> DataFrame:
    """records with the value of the build row that the first matching key finds. candidates: (key of a record, key of a build row) as text, by rank; the first
    build row in the order wins. The long form is joined once, whatever the number of keys."""
    key = lambda cols: F.array(*[F.struct(F.lit(i).alias("rank"), c.cast("string").alias("key")) for i, c in enumerate(cols)])
    probe = records.select(row, F.explode(key([a for a, _ in candidates])).alias("k")).select(row, "k.rank", "k.key").where("key is not null")
    table = build.select("*", F.explode(key([b for _, b in candidates])).alias("k")).select("*", "k.rank", "k.key").where("key is not null")
    table = one_per_key(table, ["rank", "key"], order).select("rank", "key", F.col(value).alias("__v"))
    best = probe.join(table, ["rank", "key"]).groupBy(row).agg(F.min_by("__v", "rank").alias(value), F.min("rank").alias("key_rank"))
    return records.join(best, row, "left")


def presence_key(record: Column) -> Column:
    """Struct kind, key of a record (a map of its keys): the first kind whose keys it has, null or not; else the hash of prompt or question."""
    has = lambda *names: F.lit(True) if not names else F.map_contains_key(record, F.lit(names[0])) & has(*names[1:])
    of = lambda n: F.coalesce(F.try_element_at(record, F.lit(n)), F.lit("None"))
    out = F.when(F.lit(False), F.struct(F.lit("").alias("kind"), F.lit("").alias("key")))
    for kind, names in (("uuid+gen", ("uuid", "gen_index")), ("sid+gen", ("sample_id", "gen_index")), ("id", ("id",)), ("qid", ("qid",)), ("uuid", ("uuid",)), ("sid", ("sample_id",))):
        out = out.when(has(*names), F.struct(F.lit(kind).alias("kind"), F.concat_ws("\x1f", *map(of, names)).alias("key")))
    prompt = F.when(has("prompt"), F.try_element_at(record, F.lit("prompt"))).otherwise(F.try_element_at(record, F.lit("question")))
    return out.otherwise(F.struct(F.lit("hash").alias("kind"), F.md5(F.coalesce(prompt, F.lit(""))).alias("key")))


def attached(records: DataFrame, summaries: DataFrame, key: str, value: str, order: list[Column]) -> DataFrame:
    """records with the summary of the same key (a struct as presence_key gives), null if there is none; the first summary in the order wins. Blank ones
    don't count."""
    table = one_per_key(summaries.where(F.trim(F.coalesce(F.col(value), F.lit(""))) != ""), [key], order).select(key, value)
    return records.join(table, key, "left")


def record_key(uuid: Column, sample_id: Column, ident: Column, qid: Column, prompt: Column) -> Column:
    """First identifier that is neither null nor empty, with its kind; else the hash of the prompt."""
    named = [F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{n}:"), c.cast("string"))) for n, c in (("uuid", uuid), ("sample_id", sample_id), ("id", ident), ("qid", qid))]
    return F.coalesce(*named, F.concat(F.lit("hash:"), F.md5(F.coalesce(prompt, F.lit("")))))


def key_intersection(*tables: DataFrame, keys: list[str]) -> DataFrame:
    out = tables[0].select(*keys).distinct()
    for t in tables[1:]:
        out = out.join(t.select(*keys), keys, "left_semi")
    return out
