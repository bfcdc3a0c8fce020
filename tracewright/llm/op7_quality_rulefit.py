"""Quality classifier: a sparse rule ensemble.

Shallow trees over text statistics are grown on resampled rows; every path from a root is a conjunctive rule. A lasso logistic regression over the rules
leaves few with a weight, and these are compiled into one Spark column expression, so scoring runs in generated code over the measured statistics.
Fitted to SAMPLE labelled training rows at most (those of the least hash of doc_id), which is a documented bound; all documents are scored.

Inputs are statistics of the text alone. Null text: as an empty one. Null doc_id: scored, remainder of empty text. Repeated rows: each its own row; a
document with several labels counts with the highest. No labels, or of one kind only: every score is their smoothed share (0.5 for none). Empty table: no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, documents, small_batches
from .op4_quality_rules import ledger

SAMPLE = 20_000
TREES, DEPTH, CUTS, TREE_ROWS = 24, 3, 16, 4000
LASSO, STEPS = 2e-3, 300

_W = "cast(greatest(n_words, 1) as double)"
#: Statistics over the ledger's measurements.
STATISTICS = {
    "words": "log2(n_words + 1.0d)",
    "symbols": f"n_symbols / {_W}",
    "word_length": f"word_chars / {_W}",
    "repeats": f"n_repeat_words / {_W}",
    "top_word": f"top_word / {_W}",
    "marks": f"n_marks / {_W}",
    "lines": f"n_lines / {_W}",
    "duplicate_lines": "n_dup_lines / cast(greatest(n_lines, 1) as double)",
    "capitals": "n_upper / cast(greatest(n_letters, 1) as double)",
    "letters": "n_letters / cast(greatest(word_chars, 1) as double)",
}

Rule = tuple[tuple[int, float, bool], ...]  # (statistic, threshold, whether above it)


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> list[Rule]:
    """All paths of one tree, split by Gini gain at quantiles of a random half of the statistics."""
    rules: list[Rule] = []

    def node(rows: np.ndarray, path: Rule) -> None:
        if path:
            rules.append(tuple(sorted(path)))
        if len(path) == DEPTH or len(rows) < 20 or y[rows].min() == y[rows].max():
            return
        best = (1e-9, None)
        p = y[rows].mean()
        for j in rng.permutation(x.shape[1])[: (x.shape[1] + 1) // 2]:
            v = x[rows, j]
            for cut in np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 2)[1:-1])):
                above = v > cut
                n = above.sum()
                if 5 <= n <= len(rows) - 5:
                    a, b = y[rows][above].mean(), y[rows][~above].mean()
                    gain = p * (1 - p) - (n * a * (1 - a) + (len(rows) - n) * b * (1 - b)) / len(rows)
                    if gain > best[0]:
                        best = (gain, (int(j), float(cut)))
        if best[1]:
            j, cut = best[1]
            above = x[rows, j] > cut
            node(rows[above], (*path, (j, cut, True)))
            node(rows[~above], (*path, (j, cut, False)))

    node(rng.integers(0, len(x), min(len(x), TREE_ROWS)), ())
    return rules


def holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for k, rule in enumerate(rules):
        for j, cut, above in rule:
            out[:, k] *= (x[:, j] > cut) == above
    return out


def lasso(z: np.ndarray, y: np.ndarray, strength: float = LASSO, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Logistic weights by accelerated proximal gradient; the intercept is not penalised."""
    n, m = z.shape
    a = np.hstack([np.ones((n, 1)), z])
    rate = 4 * n / max(1e-9, np.linalg.norm(a, 2) ** 2)
    w = v = np.zeros(m + 1)
    t = 1.0
    for _ in range(steps):
        g = a.T @ (1 / (1 + np.exp(-np.clip(a @ v, -30, 30))) - y) / n
        new = v - rate * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * strength, 0)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = new + (old - 1) / t * (new - w), new
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, seed: int = 11) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept, and the rules with a weight."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return float(np.log(share / (1 - share))), []
    rng = np.random.default_rng(seed)
    rules = sorted({r for _ in range(TREES) for r in grow(x, y, rng)})
    bias, weights = lasso(holds(rules, x), y)
    return bias, [(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6]


def compiled(bias: float, rules: list[tuple[Rule, float]]) -> Column:
    """The ensemble's score as a column over columns named as STATISTICS."""
    names, total = list(STATISTICS), F.lit(bias)
    for rule, weight in rules:
        test = F.lit(True)
        for j, cut, above in rule:
            test = test & ((F.col(names[j]) > F.lit(cut)) == F.lit(above))
        total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def statistics(docs: DataFrame) -> DataFrame:
    return ledger(docs).select("doc_id", *[F.expr(e).cast("double").alias(n) for n, e in STATISTICS.items()])


def training(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of SAMPLE training rows at most."""
    some = labels.where((crc_mod(F.col("doc_id"), 3) != 1) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    some = some.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    found = statistics(docs.select("doc_id", "text").join(F.broadcast(some.select("doc_id")), "doc_id")).join(F.broadcast(some), "doc_id")
    rows = found.select("doc_id", *STATISTICS, "quality").toPandas().sort_values(["doc_id", *STATISTICS], kind="stable")
    return rows[list(STATISTICS)].to_numpy(float), (rows["quality"].to_numpy(float) > 0).astype(float)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    score = compiled(*fit(*training(docs, labels)))
    out = statistics(docs).select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_quality_rulefit(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
