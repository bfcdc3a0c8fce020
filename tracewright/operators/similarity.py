"""Similarity and coverage between summary units (S) and trace units (T), in long form: rows (key, s_idx, t_idx, sim). Nothing crosses keys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.arrays import jaccard


def pairs_within(units: DataFrame, key: str) -> DataFrame:
    """units: key, side ('s' or 't'), idx, text. Each S with each T unit of its key."""
    s = units.where("side = 's'").select(key, F.col("idx").alias("s_idx"), F.col("text").alias("s_text"))
    t = units.where("side = 't'").select(key, F.col("idx").alias("t_idx"), F.col("text").alias("t_text"))
    return s.join(t, key)


def jaccard_matrix(units: DataFrame, key: str) -> DataFrame:
    """Token-set similarity; 0 where both are empty."""
    p = pairs_within(units, key)
    return p.select(key, "s_idx", "t_idx", jaccard(F.array_distinct(X.tokens(F.col("s_text"))), F.array_distinct(X.tokens(F.col("t_text"))), 0.0).alias("sim"))


def tfidf_cosine(units: DataFrame, key: str, max_df: float = 0.95) -> DataFrame:
    """Cosine of tf-idf vectors over the key's own units: words of two letters or more, idf = ln((1 + n) / (1 + df)) + 1, terms in more than max_df of the
    units dropped. Pairs that share no term are 0."""
    u = units.withColumn("terms", F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)))
    n = units.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    tf = u.select(key, "side", "idx", F.explode("terms").alias("term")).groupBy(key, "side", "idx", "term").agg(F.count(F.lit(1)).alias("tf"))
    w = tf.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy(key, "term"))).join(n, key).where(F.col("df") <= F.lit(max_df) * F.col("n"))
    w = w.withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    w = w.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key, "side", "idx"))))
    s, t = w.where("side = 's'").select(key, "term", F.col("idx").alias("s_idx"), F.col("w").alias("a")), w.where("side = 't'").select(key, "term", F.col("idx").alias("t_idx"), F.col("w").alias("b"))
    dots = s.join(t, [key, "term"]).groupBy(key, "s_idx", "t_idx").agg(F.sum(F.col("a") * F.col("b")).alias("sim"))
    return pairs_within(units, key).select(key, "s_idx", "t_idx").join(dots, [key, "s_idx", "t_idx"], "left").withColumn("sim", F.least(F.lit(1.0), F.coalesce("sim", F.lit(0.0))))


def soft_align(sims: DataFrame, key: str, theta: float = 0.05, tau: float = 0.25) -> DataFrame:
    """Softmax of sim / tau over each S unit's T units above theta; 0 elsewhere."""
    w = Window.partitionBy(key, "s_idx")
    x = F.when(F.col("sim") > theta, F.col("sim") / tau)
    e = sims.withColumn("e", F.exp(x - F.max(x).over(w)))
    return e.withColumn("a", F.coalesce(F.col("e") / F.sum("e").over(w), F.lit(0.0))).drop("e")


def weighted_coverage(aligned: DataFrame, weights: DataFrame, key: str, q: float = 0.2) -> DataFrame:
    """weights: key, t_idx, w (sum 1). wcov, wcov_top (over the top units until their weight reaches q), miss_top."""
    covered = aligned.groupBy(key, "t_idx").agg(F.least(F.lit(1.0), F.sum("a")).alias("c"))
    d = weights.join(covered, [key, "t_idx"], "left").withColumn("c", F.coalesce("c", F.lit(0.0)))
    before = F.coalesce(F.sum("w").over(Window.partitionBy(key).orderBy(F.desc("w"), "t_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    d = d.withColumn("top", before < F.lit(q - 1e-12))
    top = F.sum(F.when(F.col("top"), F.col("w")))
    share = F.when(top > 0, F.sum(F.when(F.col("top"), F.col("w") * F.col("c"))) / top).otherwise(0.0)
    return d.groupBy(key).agg(F.sum(F.col("w") * F.col("c")).alias("wcov"), share.alias("wcov_top"), (1 - share).alias("miss_top"))


def unsupported(sims: DataFrame, weights: DataFrame, key: str, floor: float = 0.2) -> DataFrame:
    """weights: key, s_idx, w. Share of S units whose best similarity is under the floor, and their weight."""
    best = sims.groupBy(key, "s_idx").agg(F.max("sim").alias("best")).join(weights, [key, "s_idx"])
    low = F.when(F.col("best") < floor, 1.0).otherwise(0.0)
    return best.groupBy(key).agg(F.avg(low).alias("unmatched_ratio"), F.sum(low * F.col("w")).alias("extraneous_salience"))


def rouge_n(df: DataFrame, row: str, ref: str, hyp: str, n: int) -> DataFrame:
    """row, f1 of clipped n-gram counts."""
    grams = lambda c, out: df.select(row, F.explode(X.ngrams(X.tokens(F.col(c)), n)).alias("g")).groupBy(row, "g").agg(F.count(F.lit(1)).alias(out))
    a, b = grams(ref, "x"), grams(hyp, "y")
    hit = a.join(b, [row, "g"]).groupBy(row).agg(F.sum(F.least("x", "y")).alias("o"))
    size = lambda c: F.greatest(F.size(X.tokens(F.col(c))) - (n - 1), F.lit(0))
    out = df.select(row, size(ref).alias("r"), size(hyp).alias("h")).join(hit, row, "left").withColumn("o", F.coalesce("o", F.lit(0)))
    return out.select(row, F.when((F.col("r") > 0) & (F.col("h") > 0), 2.0 * F.col("o") / (F.col("r") + F.col("h"))).otherwise(0.0).alias("f1"))


def lcs_f1(ref: Column, hyp: Column) -> Column:
    """F1 of the longest common subsequence of token arrays; an Arrow UDF, as the table is quadratic."""

    @F.pandas_udf("double")
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            if len(x) == 0 or len(y) == 0:
                return 0.0
            last = [0] * (len(y) + 1)
            for p in x:
                diagonal = 0
                for j, q in enumerate(y, 1):
                    keep = last[j]
                    last[j] = diagonal + 1 if p == q else max(last[j], last[j - 1])
                    diagonal = keep
            return 2.0 * last[-1] / (len(x) + len(y))

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

    return f(ref, hyp)


def coverage_report(units: DataFrame, importance: DataFrame, key: str, theta: float = 0.05, tau: float = 0.25, q: float = 0.2, floor: float = 0.2) -> DataFrame:
    """The whole chain for each key with units on both sides: weights from importance (key, side, idx, w) scaled to sum 1 (even if all are 0), tf-idf
    similarity, soft alignment, coverage and unsupported units; the keys that miss most first."""
    total = Window.partitionBy(key, "side")
    w = units.select(key, "side", "idx").join(importance, [key, "side", "idx"], "left").withColumn("w", F.coalesce("w", F.lit(1e-8)))
    w = w.withColumn("w", F.when(F.sum("w").over(total) > 0, F.col("w") / F.sum("w").over(total)).otherwise(1.0 / F.count(F.lit(1)).over(total)))
    both = units.groupBy(key).agg(F.count_if(F.col("side") == "s").alias("s"), F.count_if(F.col("side") == "t").alias("t")).where("s > 0 and t > 0").select(key)
    sims = tfidf_cosine(units.join(both, key), key)
    covered = weighted_coverage(soft_align(sims, key, theta, tau), w.join(both, key).where("side = 't'").select(key, F.col("idx").alias("t_idx"), "w"), key, q)
    bare = unsupported(sims, w.where("side = 's'").select(key, F.col("idx").alias("s_idx"), "w"), key, floor)
    return covered.join(bare, key).orderBy(F.desc("miss_top"), key)
