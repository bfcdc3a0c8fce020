"""Queries over scored leave-one-out tasks and the length baseline. Turns of a conversation stand in for steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as E
from ..functions import python as P
from ..functions import text as X
from ..operators import records as R
from ..operators import scoring as C
from ..operators.baseline import fit_line
from ..operators.importance import logp_importance
from ..operators.split import holdout
from .record_queries import _N
from .registry import query, table

BUDGET = 1200

_FIT = f"""WITH r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, length(text) AS s FROM conversations),
t AS (SELECT conv_id, unnest(range(-1, n)) AS step_index FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)),
h AS (SELECT t.conv_id, step_index, i, s, sum(s) OVER (PARTITION BY t.conv_id, step_index ORDER BY i) AS run FROM t JOIN r ON t.conv_id = r.conv_id AND i <> step_index),
u AS (SELECT *, coalesce(max(CASE WHEN run <= {BUDGET} THEN run END) OVER (PARTITION BY conv_id, step_index), 0) AS used, sum(CASE WHEN run <= {BUDGET} THEN 0 ELSE s END) OVER (PARTITION BY conv_id, step_index ORDER BY i DESC) AS back FROM h),
k AS (SELECT conv_id, step_index, count(*) FILTER (WHERE run <= {BUDGET}) AS n_head, count(*) FILTER (WHERE run > {BUDGET} AND back <= {BUDGET} - used) AS n_tail,
 coalesce(sum(s + 1) FILTER (WHERE run <= {BUDGET} OR back <= {BUDGET} - used) - 1, 0) AS chars FROM u GROUP BY ALL),
f AS (SELECT t.conv_id, t.step_index, coalesce(n_head, 0) AS n_head, coalesce(n_tail, 0) AS n_tail, -1 / CAST(1 + coalesce(chars, 0) AS DOUBLE) AS v FROM t LEFT JOIN k USING (conv_id, step_index))"""


def _fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    return C.fit_budget(R.leave_one_out(c.select("conv_id", F.transform("l", lambda x: x["text"]).alias("steps")), "steps"), "steps", BUDGET)


def _by_length() -> C.Scorer:
    """A scorer that needs no model: shorter prompts are less likely."""
    return lambda prompts: [("", [-1 / (1 + len(p))]) for p in prompts]


@query(f"{_FIT} SELECT conv_id, CAST(step_index AS BIGINT) AS step_index, n_head, n_tail FROM f")
def loo_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted(spark, sf_dir).select("conv_id", *[F.col(c).cast("long").alias(c) for c in ("step_index", "n_head", "n_tail")])


@query(f"""{_FIT}, b AS (SELECT *, max(CASE WHEN step_index = -1 THEN v END) OVER (PARTITION BY conv_id) AS base FROM f)
SELECT conv_id, CAST(step_index AS BIGINT) AS step_index, round(v, 9) AS avg_logp, round(greatest(CAST(0 AS DOUBLE), base - v), 9) AS importance FROM b WHERE step_index >= 0""")
def loo_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = _fitted(spark, sf_dir).select("conv_id", "step_index", "variant", F.array_join("steps", "\n").alias("prompt"))
    scored = logp_importance(C.score(tasks, "prompt", _by_length).drop("prompt", "logprobs"), ["conv_id"])
    return scored.select("conv_id", F.col("step_index").cast("long").alias("step_index"), F.round("avg_logp", 9).alias("avg_logp"), F.round("importance", 9).alias("importance"))


@query(f"""WITH d AS (SELECT doc_id, CAST({_N.format('text')} AS DOUBLE) AS y, CAST(length(text) AS DOUBLE) AS x, row_number() OVER (ORDER BY md5('42' || doc_id), doc_id) - 1 >= greatest(1, floor(count(*) OVER () * CAST(0.1 AS DOUBLE))) AS train FROM documents),
m AS (SELECT regr_slope(y, x) FILTER (WHERE train) AS k, regr_intercept(y, x) FILTER (WHERE train) AS c FROM d), e AS (SELECT y, k * x + c AS p FROM d, m WHERE NOT train)
SELECT count(*) AS n, round(avg(CASE WHEN abs(p - y) / greatest(abs(y), CAST(1e-6 AS DOUBLE)) <= CAST(0.33 AS DOUBLE) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS pass_at_1, round(avg(abs(p - y)), 4) AS avg_error FROM e""")
def length_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", X.token_count(F.col("text")).cast("double").alias("y"), F.length("text").cast("double").alias("x"))
    d = d.join(holdout(d, "doc_id", 0.1, 42), "doc_id")
    line = fit_line(d.where("not is_validation"), "y", "x")
    out = E.regression_metrics(d.where("is_validation").withColumn("p", line.predict(F.col("x"))), "y", "p")
    return out.select("n", F.round("pass_at_1", 6).alias("pass_at_1"), F.round("avg_error", 4).alias("avg_error"))


@query()
def text_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.normalised(P.nfkc(F.col("text")))).alias("text_md5"))
