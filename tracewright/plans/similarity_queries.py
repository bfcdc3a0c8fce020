"""Queries over similarity, coverage and segmentation. Turns of a conversation stand in: assistant turns are S units, user turns T units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import segment as G
from ..operators import similarity as M
from ..operators.records import head_tail_fit as fit
from .registry import query, table


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    return c.select("conv_id", F.when(F.col("role") == "assistant", "s").otherwise("t").alias("side"), F.col("turn").alias("idx"), "text")


_U = "SELECT conv_id, CASE WHEN role = 'assistant' THEN 's' ELSE 't' END AS side, turn AS idx, list_filter(string_split_regex(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g'), ' '), lambda x: x <> '') AS tok FROM conversations WHERE role IN ('user', 'assistant')"
_JAC = f"SELECT s.conv_id, s.idx AS s_idx, t.idx AS t_idx, CASE WHEN len(list_distinct(list_concat(s.tok, t.tok))) = 0 THEN CAST(0 AS DOUBLE) ELSE len(list_intersect(s.tok, t.tok)) / CAST(len(list_distinct(list_concat(s.tok, t.tok))) AS DOUBLE) END AS sim FROM ({_U}) s JOIN ({_U}) t ON s.conv_id = t.conv_id AND s.side = 's' AND t.side = 't'"
_TF = f"""WITH u AS ({_U}), n AS (SELECT conv_id, count(*) AS n FROM u GROUP BY 1), tf AS (SELECT conv_id, side, idx, term, count(*) AS tf FROM (SELECT conv_id, side, idx, unnest(tok) AS term FROM u) WHERE length(term) >= 2 GROUP BY ALL),
d AS (SELECT *, count(*) OVER (PARTITION BY conv_id, term) AS df FROM tf), w AS (SELECT d.*, tf * (ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1) AS w FROM d JOIN n USING (conv_id) WHERE df <= CAST(0.95 AS DOUBLE) * n),
z AS (SELECT conv_id, side, idx, term, w / sqrt(sum(w * w) OVER (PARTITION BY conv_id, side, idx)) AS w FROM w),
p AS (SELECT s.conv_id, s.idx AS s_idx, t.idx AS t_idx FROM u s JOIN u t ON s.conv_id = t.conv_id AND s.side = 's' AND t.side = 't'),
m AS (SELECT a.conv_id, a.idx AS s_idx, b.idx AS t_idx, sum(a.w * b.w) AS sim FROM z a JOIN z b ON a.conv_id = b.conv_id AND a.term = b.term AND a.side = 's' AND b.side = 't' GROUP BY ALL),
sims AS (SELECT p.*, least(CAST(1 AS DOUBLE), coalesce(sim, CAST(0 AS DOUBLE))) AS sim FROM p LEFT JOIN m USING (conv_id, s_idx, t_idx))"""
_AL = ", al AS (SELECT conv_id, s_idx, t_idx, CASE WHEN sim > CAST(0.05 AS DOUBLE) THEN exp(sim * 4) / sum(CASE WHEN sim > CAST(0.05 AS DOUBLE) THEN exp(sim * 4) END) OVER (PARTITION BY conv_id, s_idx) ELSE CAST(0 AS DOUBLE) END AS a FROM sims)"


@query(f"SELECT conv_id, s_idx, t_idx, round(sim, 6) AS sim FROM ({_JAC})")
def jaccard_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.jaccard_matrix(_units(spark, sf_dir), "conv_id").withColumn("sim", F.round("sim", 6))


@query(f"{_TF} SELECT conv_id, s_idx, t_idx, round(sim, 6) AS sim FROM sims")
def tfidf_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.tfidf_cosine(_units(spark, sf_dir), "conv_id").withColumn("sim", F.round("sim", 6))


@query(f"{_TF}{_AL} SELECT conv_id, s_idx, t_idx, round(a, 6) AS a FROM al")
def soft_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.soft_align(M.tfidf_cosine(_units(spark, sf_dir), "conv_id"), "conv_id").select("conv_id", "s_idx", "t_idx", F.round("a", 6).alias("a"))


def _weights(spark: SparkSession, sf_dir: str, side: str, name: str) -> DataFrame:
    """A unit's share of its side's characters."""
    u = _units(spark, sf_dir).where(F.col("side") == side)
    return u.select("conv_id", F.col("idx").alias(name), (F.length("text") / F.sum(F.length("text")).over(Window.partitionBy("conv_id"))).alias("w"))


@query(f"""{_TF}{_AL}, wt AS (SELECT conv_id, turn AS t_idx, length(text) / CAST(sum(length(text)) OVER (PARTITION BY conv_id) AS DOUBLE) AS w FROM conversations WHERE role = 'user'),
cov AS (SELECT conv_id, t_idx, least(CAST(1 AS DOUBLE), sum(a)) AS c FROM al GROUP BY ALL), dd AS (SELECT wt.*, coalesce(c, CAST(0 AS DOUBLE)) AS c, coalesce(sum(w) OVER (PARTITION BY conv_id ORDER BY w DESC, t_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < CAST(0.2 AS DOUBLE) - CAST(1e-12 AS DOUBLE) AS top FROM wt LEFT JOIN cov USING (conv_id, t_idx))
SELECT conv_id, round(sum(w * c), 6) AS wcov, round(sum(w * c) FILTER (WHERE top) / sum(w) FILTER (WHERE top), 6) AS wcov_top FROM dd GROUP BY conv_id""")
def weighted_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = M.soft_align(M.tfidf_cosine(_units(spark, sf_dir), "conv_id"), "conv_id")
    return M.weighted_coverage(a, _weights(spark, sf_dir, "t", "t_idx"), "conv_id").select("conv_id", F.round("wcov", 6).alias("wcov"), F.round("wcov_top", 6).alias("wcov_top"))


@query(f"""WITH j AS ({_JAC}), b AS (SELECT conv_id, s_idx, max(sim) AS best FROM j GROUP BY ALL), w AS (SELECT conv_id, turn AS s_idx, length(text) / CAST(sum(length(text)) OVER (PARTITION BY conv_id) AS DOUBLE) AS w FROM conversations WHERE role = 'assistant')
SELECT conv_id, round(avg(CASE WHEN best < CAST(0.2 AS DOUBLE) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS unmatched_ratio, round(sum(CASE WHEN best < CAST(0.2 AS DOUBLE) THEN w ELSE CAST(0 AS DOUBLE) END), 6) AS extraneous_salience FROM b JOIN w USING (conv_id, s_idx) GROUP BY conv_id""")
def hallucination(spark: SparkSession, sf_dir: str) -> DataFrame:
    sims = M.jaccard_matrix(_units(spark, sf_dir), "conv_id")
    return M.unsupported(sims, _weights(spark, sf_dir, "s", "s_idx"), "conv_id").select("conv_id", F.round("unmatched_ratio", 6).alias("unmatched_ratio"), F.round("extraneous_salience", 6).alias("extraneous_salience"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    side = lambda role, out: c.where(F.col("role") == role).groupBy("conv_id").agg(F.min_by("text", "turn").alias(out))
    return side("user", "ref").join(side("assistant", "hyp"), "conv_id")


@query(f"""WITH f AS (SELECT conv_id, side, tok FROM ({_U}) QUALIFY row_number() OVER (PARTITION BY conv_id, side ORDER BY idx) = 1),
g AS (SELECT conv_id, side, unnest(list_transform(range(1, greatest(1, len(tok))), lambda i: tok[i] || ' ' || tok[i + 1])) AS g FROM f WHERE len(tok) >= 2), k AS (SELECT conv_id, side, g, count(*) AS c FROM g GROUP BY ALL),
o AS (SELECT a.conv_id, sum(least(a.c, b.c)) AS o FROM k a JOIN k b ON a.conv_id = b.conv_id AND a.g = b.g AND a.side = 't' AND b.side = 's' GROUP BY 1)
SELECT t.conv_id, round(CASE WHEN len(t.tok) > 1 AND len(s.tok) > 1 THEN CAST(2 AS DOUBLE) * coalesce(o, 0) / (len(t.tok) + len(s.tok) - 2) ELSE CAST(0 AS DOUBLE) END, 6) AS rouge2 FROM f t JOIN f s ON t.conv_id = s.conv_id AND t.side = 't' AND s.side = 's' LEFT JOIN o ON o.conv_id = t.conv_id""")
def rouge_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rouge_n(_pairs(spark, sf_dir), "conv_id", "ref", "hyp", 2).select("conv_id", F.round("f1", 6).alias("rouge2"))


@query()
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("conv_id", M.lcs_f1(X.tokens(F.col("ref")), X.tokens(F.col("hyp"))).alias("rouge_l"))


@query("""WITH s AS (SELECT conv_id, turn, length(text) AS n FROM conversations), h AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) <= 1200 AS head, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM s),
u AS (SELECT *, coalesce(max(CASE WHEN head THEN run END) OVER (PARTITION BY conv_id), 0) AS used, sum(CASE WHEN head THEN 0 ELSE n END) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM h)
SELECT conv_id, turn, head OR back <= 1200 - used AS kept FROM u""")
def head_tail_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return fit(c, ["conv_id"], "turn", "n", 1200).select("conv_id", "turn", "kept")


@query()
def sentence_segments_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.sentence_rows(table(spark, sf_dir, "documents"), "doc_id", "text", "v1")


@query()
def sentence_segments_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.sentence_rows(table(spark, sf_dir, "documents"), "doc_id", "text", "v2")


@query()
def macro_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.macro_rows(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def macro_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.macro_rows(table(spark, sf_dir, "documents"), "doc_id", "text", most=26)
