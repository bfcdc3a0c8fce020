"""Leave-one-out tasks through a scorer: budget, prompt, batched scoring, mean log probability, importance.

A scorer maps a list of prompts to a list of (output, log probabilities of the output's tokens). It is built once in each task by a factory, so a model is
loaded where it runs and a lost executor only repeats its own batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import head_tail_steps, mean_finite

Scorer = Callable[[list[str]], list[tuple[str, list[float]]]]


def empty_scorer() -> Scorer:
    """The offline default: no output and no log probabilities."""
    return lambda prompts: [("", []) for _ in prompts]


def fit_budget(tasks: DataFrame, steps: str, budget: int, count: Callable[[Column], Column] = F.length) -> DataFrame:
    """tasks with steps cut to the budget (heads, then tails), and n_head, n_tail and n_cut for the log of what was cut."""
    sizes = F.transform(steps, lambda x: F.coalesce(count(x), F.lit(0)).cast("long"))
    out = tasks.withColumn("__fit", head_tail_steps(F.col(steps), sizes, budget)).withColumn("n_cut", F.size(steps) - F.col("__fit.n_head") - F.col("__fit.n_tail"))
    return out.withColumns({steps: F.col("__fit.kept"), "n_head": F.col("__fit.n_head"), "n_tail": F.col("__fit.n_tail")}).drop("__fit")


def cut_log(fitted: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks that lost steps."""
    return fitted.where("n_cut > 0").select(*keys, "n_head", "n_tail", "n_cut")


def score(tasks: DataFrame, prompt: str, factory: Callable[[], Scorer] = empty_scorer, batch: int = 32) -> DataFrame:
    """tasks with output, logprobs and avg_logp (mean of the finite ones, NaN if none). A null prompt is scored as an empty one. No shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = factory()
        for frame in frames:
            prompts = [p if isinstance(p, str) else "" for p in frame[prompt]]
            found = [r for at in range(0, len(prompts), batch) for r in scorer(prompts[at : at + batch])]
            yield frame.assign(output=[o for o, _ in found], logprobs=[p for _, p in found])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tasks.schema)
    return tasks.mapInPandas(run, f"{fields}, output string, logprobs array<double>").withColumn("avg_logp", mean_finite(F.col("logprobs")))


def is_match(answer: Column, gold: Column, empty_gold: int | None = None) -> Column:
    """1 if two normalised answers agree, else 0; empty_gold (null or 0) where the gold is empty."""
    return F.when(F.coalesce(gold, F.lit("")) == "", F.lit(empty_gold).cast("int")).otherwise(F.coalesce((answer == gold).cast("int"), F.lit(0)))
