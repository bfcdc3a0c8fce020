"""Queries over records: extraction from turns, unified projections, joins, splits, leave-one-out tasks, importance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as X
from ..operators import importance as I
from ..operators import joins as J
from ..operators import records as R
from ..operators import split as S
from .registry import query, table

_PROMPT = "SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'user' AND trim(text) <> ''), '') AS prompt FROM conversations GROUP BY conv_id"
_ANSWER = "SELECT conv_id, coalesce(arg_max(text, turn) FILTER (WHERE role = 'assistant'), arg_max(text, turn)) AS answer FROM conversations GROUP BY conv_id"
_N = "len(list_filter(string_split_regex({}, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> ''))"


@query(_PROMPT)
def prompt_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.turns_to_record(table(spark, sf_dir, "conversations")).select("conv_id", "prompt")


@query(_ANSWER)
def answer_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.turns_to_record(table(spark, sf_dir, "conversations")).select("conv_id", "answer")


@query(f"SELECT conv_id, md5(prompt) AS prompt_md5, md5(answer) AS answer_md5, CAST({_N.format('answer')} AS BIGINT) AS reasoning_token_count FROM ({_PROMPT}) JOIN ({_ANSWER}) USING (conv_id)")
def unified_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.turns_to_record(table(spark, sf_dir, "conversations"))
    return r.select("conv_id", F.md5("prompt").alias("prompt_md5"), F.md5("answer").alias("answer_md5"), X.token_count(F.col("answer")).cast("long").alias("reasoning_token_count"))


@query(f"SELECT conv_id, md5('Problem: ' || prompt || chr(10) || 'Answer: ' || answer || chr(10) || 'The problem has ' || {_N.format('prompt')} || ' tokens, and the answer has ' || {_N.format('answer')} || ' tokens.') AS prompt_md5, {_N.format('answer')} || '.' AS response FROM ({_PROMPT}) JOIN ({_ANSWER}) USING (conv_id)")
def count_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.turns_to_record(table(spark, sf_dir, "conversations"))
    p, a = X.token_count(F.col("prompt")), X.token_count(F.col("answer"))
    return r.select("conv_id", F.md5(X.record_template(F.col("prompt"), F.col("answer"), p, a)).alias("prompt_md5"), F.concat(a.cast("string"), F.lit(".")).alias("response"))


@query("""WITH k AS (SELECT conv_id, CAST(count(*) AS INT) AS n, list(md5(text) ORDER BY turn) AS steps FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN k = -1 THEN 'base' ELSE 'drop_' || k END AS variant, CAST(k AS BIGINT) AS step_index, array_to_string(list_filter(steps, lambda x, i: i - 1 <> k), ',') AS steps FROM (SELECT conv_id, steps, unnest(range(-1, n)) AS k FROM k)""")
def loo_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.md5("text").alias("m")))).alias("l"))
    t = R.leave_one_out(c.select("conv_id", F.transform("l", lambda x: x["m"]).alias("steps")), "steps")
    return t.select("conv_id", "variant", F.col("step_index").cast("long").alias("step_index"), F.array_join("steps", ",").alias("steps"))


_LOG = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, -l_discount - l_tax AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS rn FROM lineitem"
_IMP = f"SELECT l_orderkey, rn - 2 AS step_index, greatest(CAST(0 AS DOUBLE), b - v) AS imp FROM (SELECT *, max(CASE WHEN rn = 1 THEN v END) OVER (PARTITION BY l_orderkey) AS b FROM ({_LOG})) WHERE rn > 1"
_NORM = {
    "none": "imp",
    "minmax": "CASE WHEN max(imp) OVER w > min(imp) OVER w THEN (imp - min(imp) OVER w) / (max(imp) OVER w - min(imp) OVER w) ELSE CAST(0 AS DOUBLE) END",
    "softmax": "exp(imp - max(imp) OVER w) / sum(exp(imp - m)) OVER w",
    "zscore": "(imp - avg(imp) OVER w) / CASE WHEN stddev_pop(imp) OVER w > 1e-12 THEN stddev_pop(imp) OVER w ELSE CAST(1 AS DOUBLE) END",
}


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    d = table(spark, sf_dir, "lineitem").withColumn("rn", F.row_number().over(w)).withColumn("avg_logp", -F.col("l_discount") - F.col("l_tax"))
    return d.select("l_orderkey", F.when(F.col("rn") == 1, "base").otherwise(F.concat(F.lit("drop_"), (F.col("rn") - 2).cast("string"))).alias("variant"), (F.col("rn") - 2).cast("long").alias("step_index"), "avg_logp")


def _normalised(how: str):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = I.logp_importance(_log(spark, sf_dir), ["l_orderkey"]).withColumn("importance", F.round("importance", 9))
        return I.normalised(d, ["l_orderkey"], "importance", how, "y").select("l_orderkey", "step_index", (F.round("y", 6) + F.lit(0.0)).alias("importance"))

    return f


for _how, _sql in _NORM.items():
    query(f"SELECT l_orderkey, CAST(step_index AS BIGINT) AS step_index, round(CAST({_sql} AS DOUBLE), 6) + CAST(0 AS DOUBLE) AS importance FROM (SELECT *, max(imp) OVER (PARTITION BY l_orderkey) AS m FROM (SELECT l_orderkey, step_index, round(imp, 9) AS imp FROM ({_IMP}))) WINDOW w AS (PARTITION BY l_orderkey)", f"logp_importance_{_how}")(_normalised(_how))

_EVENTS = "SELECT *, CASE WHEN value IS NULL THEN NULL WHEN value > 100 THEN 1 ELSE 0 END AS is_match, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events"


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    d = table(spark, sf_dir, "events").withColumn("rn", F.row_number().over(w)).withColumn("is_match", F.when(F.col("value").isNull(), None).when(F.col("value") > 100, 1).otherwise(0))
    return d.select("user_id", "event_id", "is_match", F.when(F.col("rn") == 1, "base").otherwise(F.concat(F.lit("drop_"), (F.col("rn") - 2).cast("string"))).alias("variant"))


@query(f"SELECT user_id, event_id, CAST(b AS BIGINT) AS base_is_match, CAST(b - is_match AS BIGINT) AS imp_bin FROM (SELECT *, max(CASE WHEN rn = 1 THEN is_match END) OVER (PARTITION BY user_id) AS b FROM ({_EVENTS})) WHERE rn > 1 AND b IS NOT NULL AND is_match IS NOT NULL")
def binary_step_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = I.binary_importance(_matches(spark, sf_dir), ["user_id"])
    return d.select("user_id", "event_id", F.col("base_is_match").cast("long").alias("base_is_match"), F.col("imp_bin").cast("long").alias("imp_bin"))


@query(f"SELECT user_id, event_id, CAST(coalesce(greatest(0, b - is_match), 0) AS BIGINT) AS acc_importance FROM (SELECT *, max(CASE WHEN rn = 1 THEN is_match END) OVER (PARTITION BY user_id) AS b FROM ({_EVENTS})) WHERE rn > 1 AND b IS NOT NULL")
def acc_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.accuracy_importance(_matches(spark, sf_dir), ["user_id"]).select("user_id", "event_id", F.col("acc_importance").cast("long").alias("acc_importance"))


@query("SELECT d.doc_id, d.source, CAST(coalesce(l.quality, -1) AS BIGINT) AS quality FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)")
def summary_join_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return J.last_wins_join(d, l, ["doc_id"], [F.desc("quality")], "left").select("doc_id", "source", F.coalesce("quality", F.lit(-1)).cast("long").alias("quality"))


@query("""WITH b AS (SELECT doc_id * 2 AS b_id, md5(text) AS h, doc_id AS v FROM documents), i AS (SELECT b_id, min(v) AS v FROM b GROUP BY b_id), h AS (SELECT h, min(v) AS v FROM b GROUP BY h)
SELECT d.doc_id, coalesce(i.v, h.v) AS found, CAST(CASE WHEN i.v IS NOT NULL THEN 0 ELSE 1 END AS BIGINT) AS key_rank FROM documents d LEFT JOIN i ON d.doc_id = i.b_id LEFT JOIN h ON md5(d.text) = h.h""")
def summary_join_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    build = d.select((F.col("doc_id") * 2).alias("b_id"), F.col("h").alias("b_h"), F.col("doc_id").alias("found"))
    out = J.fallback_join(d, build, "doc_id", [(F.col("doc_id"), F.col("b_id")), (F.col("h"), F.col("b_h"))], "found", [F.col("found")])
    return out.select("doc_id", "found", F.col("key_rank").cast("long").alias("key_rank"))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_quantity, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def raw_segment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_orderdate")
    out = J.last_wins_join(table(spark, sf_dir, "lineitem"), raw, ["l_orderkey"], [F.desc("o_orderdate")])
    return out.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_quantity", "o_orderstatus")


@query("SELECT o_orderkey AS k FROM orders INTERSECT SELECT l_orderkey FROM lineitem INTERSECT SELECT c_custkey FROM customer")
def three_way_key_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = [table(spark, sf_dir, t).select(F.col(c).alias("k")) for t, c in (("orders", "o_orderkey"), ("lineitem", "l_orderkey"), ("customer", "c_custkey"))]
    return J.key_intersection(*ids, keys=["k"])


_RANK = "SELECT o_custkey, count(*) AS n_rows, row_number() OVER (ORDER BY md5('42' || o_custkey), o_custkey) - 1 AS rk, count(*) OVER () AS n, coalesce(sum(count(*)) OVER (ORDER BY md5('42' || o_custkey), o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM orders GROUP BY o_custkey"


@query(f"SELECT o_custkey, rk < greatest(1, CAST(floor(n * CAST(0.1 AS DOUBLE)) AS BIGINT)) AS is_validation FROM ({_RANK})")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.holdout(table(spark, sf_dir, "orders"), "o_custkey", 0.1, 42)


@query(f"SELECT o_custkey, CASE WHEN rk // (n // 5) < 5 THEN CAST(rk // (n // 5) AS BIGINT) END AS fold FROM ({_RANK})")
def kfold_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.kfold(table(spark, sf_dir, "orders"), "o_custkey", 5, 42)


@query(f"""WITH RECURSIVE g AS ({_RANK}), w AS (SELECT o_custkey, rk, CAST(n_rows AS BIGINT) AS total, true AS taken FROM g WHERE rk = 0
 UNION ALL SELECT g.o_custkey, g.rk, CAST(w.total + CASE WHEN w.total + g.n_rows <= 2000 THEN g.n_rows ELSE 0 END AS BIGINT), w.total + g.n_rows <= 2000 FROM w JOIN g ON g.rk = w.rk + 1 WHERE w.total < 2000),
 i AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM w WHERE taken)),
 m AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM w WHERE taken) ORDER BY md5('42' || o_orderkey), o_orderkey LIMIT greatest(0, 2000 - (SELECT count(*) FROM i))) SELECT * FROM i UNION ALL SELECT * FROM m""")
def group_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: the limit is the feature."""
    return S.group_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 2000, 42, ["o_orderkey"])


@query(f"SELECT o_orderkey, o_custkey, CASE WHEN rk < greatest(1, CAST(floor(n * CAST(0.1 AS DOUBLE)) AS BIGINT)) THEN 'validation' ELSE 'training' END AS side FROM orders JOIN ({_RANK}) USING (o_custkey)")
def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    valid, rest = S.parted(d, S.holdout(d, "o_custkey", 0.1, 42), "o_custkey", "is_validation")
    return valid.withColumn("side", F.lit("validation")).unionByName(rest.withColumn("side", F.lit("training")))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('7' || o_orderkey), o_orderkey LIMIT 500")
def uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: the limit is the feature."""
    return S.uniform_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 500, 7)


@query("SELECT 'hash:' || md5(text) AS k, CAST(count(*) AS BIGINT) AS n FROM documents WHERE doc_id % 2 = 1 GROUP BY 1 UNION ALL SELECT 'uuid:' || doc_id, 1 FROM documents WHERE doc_id % 2 = 0")
def record_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    none = F.lit(None).cast("string")
    key = J.record_key(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")), none, F.lit(""), none, F.col("text"))
    return d.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query()
def three_segment_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three quotas over the whole table, with three segments of varying length; a brute-force test stands for SQL."""
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_quantity").cast("int") * 2).alias("a"), (F.col("l_linenumber") * 9).cast("int").alias("b"), F.pmod("l_partkey", F.lit(60)).cast("int").alias("c")).distinct()
    q = A.three_quotas(F.col("a"), F.col("b"), F.col("c"), F.lit(100))
    return d.select("*", *[q[f"x{i}"].cast("long").alias(f"quota_{x}") for i, x in enumerate("abc")])
