"""Samples for leave-one-out scoring: alignment of records with their segments, budgets, prompts and side logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import head_tail_steps
from ..functions.prompts import chat_prompt
from ..functions.text import strip, token_count
from .joins import last_wins_join
from .records import leave_one_out

#: Stands between heads and tails.
GAP = "<...>"


def first_of(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of the columns that df has which is neither null nor empty; else ''."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names if n in df.columns], F.lit(""))


def aligned(segments: DataFrame, raw: DataFrame, keys: list[str], order: list[Column], gold: tuple[str, ...] = ("answer_gold",), not_blank: bool = False) -> DataFrame:
    """keys, problem, gold_answer, steps, full_trace. segments: keys and steps. The raw record that comes first in the order wins a key; segments without
    one go. not_blank: blank steps go, and samples left without any."""
    names = [c for c in ("problem", "question", "prompt", *gold) if c in raw.columns]
    out = last_wins_join(segments.select(*keys, "steps"), raw, keys, order)
    steps = F.filter("steps", lambda x: F.coalesce(strip(x), F.lit("")) != "") if not_blank else F.col("steps")
    problem, answer = first_of(raw.select(*names), ("problem", "question", "prompt")), first_of(raw.select(*names), gold)
    out = out.select(*keys, problem.alias("problem"), answer.alias("gold_answer"), steps.alias("steps"))
    out = out.where(F.size("steps") > 0) if not_blank else out
    return out.withColumn("full_trace", F.array_join("steps", "\n"))


def with_budget(samples: DataFrame, kind: str, budget: int, count: Callable[[Column], Column] = token_count) -> tuple[DataFrame, DataFrame]:
    """Samples whose prompt fits without any hint, and the log of the others."""
    sized = samples.withColumn("empty_prompt_tokens", count(chat_prompt(kind, F.col("problem"), F.lit(""), F.col("gold_answer"))).cast("long"))
    log = sized.where(F.col("empty_prompt_tokens") > budget).withColumns({"reason": F.lit("problem_too_long"), "ctx_budget": F.lit(budget).cast("long")})
    return sized.where(F.col("empty_prompt_tokens") <= budget), log.drop("problem", "gold_answer", "steps", "full_trace")


def tasks(samples: DataFrame, kind: str, budget: int, count: Callable[[Column], Column] = token_count, gap_always: bool = False) -> DataFrame:
    """A base row and one for each dropped step, with hints and prompt, n_head, n_tail and n_cut. samples come from with_budget. Steps that don't fit what
    the prompt leaves of the budget are cut from the middle, where GAP stands. gap_always: it stands wherever steps were fitted, cut or not. count must add up
    over texts set apart by white space, as words do."""
    rows = leave_one_out(samples, "steps")
    sizes = F.transform("steps", lambda x: F.coalesce(count(x), F.lit(0)).cast("long"))
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)
    room = F.lit(budget) - F.col("empty_prompt_tokens")
    rows = rows.withColumns({"__sizes": sizes, "__over": total > room}).withColumn("__fit", head_tail_steps(F.col("steps"), F.col("__sizes"), room - count(F.lit(GAP))))
    n = lambda name: F.when(F.col("__over"), F.col(f"__fit.{name}"))
    cut = F.when(F.col("__over"), F.size("steps") - F.col("__fit.n_head") - F.col("__fit.n_tail")).otherwise(0)
    rows = rows.withColumns({"n_head": F.coalesce(n("n_head"), F.size("steps")), "n_tail": F.coalesce(n("n_tail"), F.lit(0)), "n_cut": cut})
    head, tail = F.slice("steps", F.lit(1), F.col("n_head")), F.slice("steps", F.size("steps") - F.col("n_tail") + 1, F.col("n_tail"))
    some = F.col("n_head") + F.col("n_tail") > 0
    gap = F.when(some & (F.col("__over") if gap_always else F.col("n_cut") > 0), F.array(F.lit(GAP))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("hints", F.array_join(F.concat(head, gap, tail), "\n"))
    return rows.withColumn("prompt", chat_prompt(kind, F.col("problem"), F.col("hints"), F.col("gold_answer"))).drop("__sizes", "__over", "__fit")


def truncated_log(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each sample that lost steps, the variants that did."""
    cut = rows.where("n_cut > 0")
    return cut.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("step_index", "n_head", "n_tail", "n_cut"))).alias("truncated_variants"))


def complete(log: DataFrame, keys: tuple[str, ...] = ("uuid", "gen_index", "step_index"), granularity: str | None = None) -> DataFrame:
    """Rows of an ablation log that have all keys, of one granularity if given."""
    for k in keys:
        log = log.where(F.col(k).isNotNull())
    return log.where(F.col("granularity") == granularity) if granularity else log
