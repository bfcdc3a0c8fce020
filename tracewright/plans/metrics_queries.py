"""Queries over the metrics of length prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as X
from ..functions import metrics as M
from ..functions.metrics import losses
from ..functions.metrics import regression_metrics as metrics
from .registry import query, table

_ROUNDED = ("pass_at_1", "avg_error", "aggregated_error")


def _rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("""
WITH t AS (SELECT l_extendedprice AS y, l_quantity * CAST(1000 AS DOUBLE) AS p FROM lineitem)
SELECT count(*) AS n,
  round(avg(CASE WHEN abs(p - y) / greatest(abs(y), CAST(1e-6 AS DOUBLE)) <= CAST(0.33 AS DOUBLE) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS pass_at_1,
  round(avg(abs(p - y)), 6) AS avg_error,
  round(abs(sum(p - y)) / greatest(sum(abs(y)), CAST(1e-6 AS DOUBLE)), 6) AS aggregated_error
FROM t
""")
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000.0).alias("p"))
    return _rounded(metrics(rows, "y", "p"), *_ROUNDED)


_M = """count(*) AS n, round(avg(CASE WHEN abs(p - y) / greatest(abs(y), CAST(1e-6 AS DOUBLE)) <= CAST(0.33 AS DOUBLE) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS pass_at_1,
  round(avg(abs(p - y)), 6) AS avg_error, round(abs(sum(p - y)) / greatest(sum(abs(y)), CAST(1e-6 AS DOUBLE)), 6) AS aggregated_error"""


@query(f"SELECT o_orderpriority, {_M} FROM (SELECT o_orderpriority, l_extendedprice AS y, l_quantity * CAST(1000 AS DOUBLE) AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY o_orderpriority")
def regression_metrics_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000.0).alias("p"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return _rounded(metrics(l.join(o, "l_orderkey"), "y", "p", ["o_orderpriority"]), *_ROUNDED)


@query("SELECT round(avg(CASE WHEN r <= CAST(0.1 AS DOUBLE) THEN r * r / 2 ELSE CAST(0.005 AS DOUBLE) + CAST(0.1 AS DOUBLE) * (r - CAST(0.1 AS DOUBLE)) END), 6) AS huber, round(abs(sum(p - y)) / sum(abs(y)), 6) AS bias FROM (SELECT *, abs(p - y) / greatest(abs(y), CAST(1e-6 AS DOUBLE)) AS r FROM (SELECT l_extendedprice AS y, l_quantity * CAST(1000 AS DOUBLE) AS p FROM lineitem))")
def huber_bias_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000.0).alias("p"))
    return _rounded(losses(rows, "y", "p").select("huber", "bias"), "huber", "bias")


_EDGES = [100.0, 200.0, 400.0, 800.0]


@query("SELECT CAST(CASE WHEN y <= 100 THEN 0 WHEN y <= 200 THEN 1 WHEN y <= 400 THEN 2 ELSE 3 END AS BIGINT) AS class, count(*) AS n FROM (SELECT len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) AS y FROM documents) GROUP BY 1")
def bucketize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = X.token_count(F.col("text"))
    return table(spark, sf_dir, "documents").groupBy(A.bucket(y, _EDGES).cast("long").alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {_M} FROM (SELECT y, CAST([50, 150, 300, 600][CASE WHEN q <= 100 THEN 1 WHEN q <= 200 THEN 2 WHEN q <= 400 THEN 3 ELSE 4 END] AS DOUBLE) AS p FROM (SELECT CAST(n_chars AS DOUBLE) / 6 AS y, doc_id % 900 AS q FROM documents))")
def class_center_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = A.bucket(F.col("doc_id") % 900, _EDGES)
    p = F.get(F.array(*map(F.lit, A.centres(_EDGES))), k)
    return _rounded(metrics(table(spark, sf_dir, "documents").select((F.col("n_chars").cast("double") / 6).alias("y"), p.alias("p")), "y", "p"), *_ROUNDED)


@query("SELECT label, i AS dim, round(avg(x), 6) AS mean FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, i")
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding is pooled from two token vectors, of which the mask keeps the first; then the vectors of a label are averaged."""
    e = table(spark, sf_dir, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    other = F.transform("v", lambda x: x + 1)
    e = e.select("label", F.posexplode(A.masked_mean(F.array("v", other), F.array(F.lit(1), F.lit(0)))).alias("i", "x"))
    return e.groupBy("label", (F.col("i") + 1).cast("long").alias("dim")).agg(F.round(F.avg("x"), 6).alias("mean"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS max FROM events GROUP BY event_type")
def coverage_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = M.described(table(spark, sf_dir, "events"), "value", ["event_type"])
    d = d.withColumnsRenamed({"std": "sd", "low": "min", "high": "max"})
    return _rounded(d, "mean", "sd", "q25", "q50", "q75").select("event_type", "n", "mean", "sd", "min", "q25", "q50", "q75", "max")


@query("SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.windows import tumbling

    return tumbling(table(spark, sf_dir, "events")).select(F.col("w.start").cast("long").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
