"""Mixing sources to target weights by Pfair scheduling.

A source's rows are cut into blocks of equal size. With weight w, its k-th block (from 1) is released at slot floor((k - 1) / w) and due at ceil(k / w).
Earliest-deadline-first among released blocks then gives each slot to one source, and every source stays within one block of its share.

Weights are used as exact fractions over the whole schedule. It depends on the weights and the numbers of blocks alone: the driver works it out, holding one
block of each source at a time, and writes it to a table in chunks; rows find their slot by a join. A source whose blocks are spent leaves its slots empty;
the others keep their proportions. All rows are placed once.

interleaved writes the order down as the order of rows in files; pack_mixed of op6 reads it from there.

Null source, or none: a source of its own, named ''. Null doc_id: as any other. Repeated rows: each placed; in interleaved they stand together, at the first
place. Very long texts: only hashed. Ties of doc_id: by the text's hash. Extra columns, whatever their names: not read; interleaved keeps them. Empty table:
no rows.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, free_name, materialise, ranked, scratch

BLOCK = 64
#: Target weights where none are given: shares of rows to this power, which lifts small sources.
TEMPER = 0.5
#: Blocks of the schedule that the driver holds at once.
CHUNK = 1 << 17


def quotas(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole slots for each source, at least one, that add up to the period (largest remainder): for schedules that must repeat. mix doesn't round."""
    total = sum(weights.values())
    exact = {s: w / total * (period - len(weights)) for s, w in weights.items()}
    got = {s: math.floor(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (got[s] - exact[s], s))[: period - len(weights) - sum(got.values())]:
        got[s] += 1
    return {s: n + 1 for s, n in got.items()}


def schedule(weights: dict[str, float], blocks: dict[str, int] | None = None) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, k from 0, release, deadline, slot) of every block, in order of slot; each runs within its window. blocks: of each source; if None, whole
    weights give one period."""
    blocks = blocks or weights
    total = sum(map(Fraction, weights.values()))
    pace = {s: (r.numerator, r.denominator) for s, w in weights.items() for r in [total / Fraction(w)]}  # slots from block to block
    window = lambda s, k: (k * pace[s][0] // pace[s][1], -(-(k + 1) * pace[s][0] // pace[s][1]))
    waiting = [(0, window(s, 0)[1], s, 0) for s in weights if blocks[s] > 0]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, due, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, k, release))
        due, s, k, release = heapq.heappop(ready)
        if not release <= slot < due:
            raise ArithmeticError(f"block {k} of {s} misses its window")
        yield s, k, release, due, slot
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, (*window(s, k + 1), s, k + 1))
        slot += 1


def schedule_table(spark: SparkSession, weights: dict[str, float], counts: dict[str, int], block: int) -> DataFrame:
    """source, block, release, deadline, slot, start (rows of all earlier slots)."""
    path = f"{scratch(spark)}/mix-schedule-{uuid.uuid4().hex}"
    names = ["source", "block", "release", "deadline", "slot", "start"]
    at, plan = 0, schedule(weights, {s: -(-n // block) for s, n in counts.items()})
    while chunk := list(islice(plan, CHUNK)):
        starts = []
        for s, k, *_ in chunk:
            starts.append(at)
            at += min(block, counts[s] - k * block)
        columns = [*map(list, zip(*chunk, strict=True)), starts]
        spark.createDataFrame(pa.table([pa.array(x, pa.int64() if i else pa.string()) for i, x in enumerate(columns)], names)).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, tie (hash of the text), source, block (from 0 in its source), release, deadline, slot, position (gapless from 0 over all rows, in slot order)."""
    spark = docs.sparkSession
    tie = F.xxhash64("text") if "text" in docs.columns else F.lit(0).cast("long")
    rows = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), tie.alias("tie"), (F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")).alias("source")), "mix-rows")
    counts = {r[0]: r[1] for r in rows.groupBy("source").agg(F.count(F.lit(1))).collect()}  # a row for each source, as many as weights
    named = "doc_id long, tie long, source string, block long, release long, deadline long, slot long, position long"
    if not counts:
        return spark.createDataFrame([], named)
    missing = set(counts) - set(weights or counts)
    if missing:
        raise ValueError(f"no target weight for {sorted(missing)[:5]}")
    target = {s: (weights[s] if weights else n**TEMPER) for s, n in counts.items()}
    if min(target.values()) <= 0:
        raise ValueError("target weights must be above 0")
    table = schedule_table(spark, target, counts, block)
    numbered = ranked(rows, ["source"], ["doc_id", "tie"], "n").withColumn("block", F.floor(F.col("n") / block))
    return numbered.join(table, ["source", "block"]).select("doc_id", "tie", "source", "block", "release", "deadline", "slot", (F.col("start") + F.pmod("n", F.lit(block))).cast("long").alias("position"))


def interleaved(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """docs, with all their columns, in the order of their positions: dealt by ranges of it, and sorted within each."""
    i, t, at = (free_name(docs, n) for n in ("id", "tie", "position"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    tie = F.xxhash64("text") if "text" in docs.columns else F.lit(0).cast("long")
    found = mix(docs, weights, block).groupBy(key.alias(i), F.col("tie").alias(t)).agg(F.min("position").alias(at))
    out = docs.withColumns({i: key, t: tie}).join(found, [i, t])
    return out.repartitionByRange(at).sortWithinPartitions(at).select(docs.columns)


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).drop("tie")
