"""Queries over text functions. Rows without think blocks, boxed answers or tags are given them here, the same way on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as X
from .registry import query, table

_WS = r"'^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g'"
_strip = lambda s: f"regexp_replace({s}, {_WS})"


@query(f"""SELECT doc_id, CAST(len(regexp_extract_all(t, '(?s)<think>(.*?)</think>', 1)) AS BIGINT) AS n_think, md5(regexp_extract_all(t, '(?s)<think>(.*?)</think>', 1)[1]) AS body_md5,
 md5({_strip("string_split(t, '</think>')[-1]")}) AS tail_md5 FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE '<think>' || text || '</think>' || CASE WHEN doc_id % 3 = 1 THEN ' tail ' || substr(text, 1, 40) ELSE '' END END AS t FROM documents)""")
def think_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    t = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("<think>"), "text", F.lit("</think>"), F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" tail "), F.substring("text", 1, 40))).otherwise("")))
    d = d.select("doc_id", t.alias("t"))
    bodies = X.think_bodies(F.col("t"))
    return d.select("doc_id", F.size(bodies).cast("long").alias("n_think"), F.md5(F.get(bodies, 0)).alias("body_md5"), F.md5(X.think_tail(F.col("t"))).alias("tail_md5"))


@query("""SELECT p_partkey, p_brand AS boxed, p_brand AS unwrapped, 'see \\boxed{' || p_brand || '}' AS not_whole, '\\boxed{' || p_brand || '}' AS model_answer FROM part""")
def boxed_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    t = F.concat(F.lit("x \\boxed{"), F.col("p_size").cast("string"), F.lit("} y \\boxed{ "), "p_brand", F.lit(" } z"))
    whole = F.concat(F.lit(" \\boxed{"), "p_brand", F.lit("} "))
    return p.select("p_partkey", X.last_boxed(t).alias("boxed"), X.unwrapped(whole).alias("unwrapped"), X.unwrapped(F.concat(F.lit("see"), whole)).alias("not_whole"), X.model_answer(t).alias("model_answer"))


@query("""SELECT p_partkey, replace(p_type, ' ', '') AS norm, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_brand END AS final FROM part""")
def answer_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    t = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("so \\boxed{"), size, F.lit("} then \\boxed{9}"))).otherwise(F.concat(F.lit("work\nFinal Answer: "), "p_brand", F.lit("\nmore")))
    return p.select("p_partkey", X.answer_norm(F.concat(F.lit("$\\left("), "p_type", F.lit("\\right)$\\quad"))).alias("norm"), X.final_answer(t).alias("final"))


@query("""SELECT doc_id, md5(CASE WHEN g = '' THEN text ELSE regexp_replace(text, '(?i)' || g, '<ANS>', 'g') END) AS scrubbed_md5 FROM (SELECT *, regexp_extract(text, '[A-Za-z]+', 0) AS g FROM documents)""")
def answer_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("g", F.regexp_extract("text", "[A-Za-z]+", 0))
    return d.select("doc_id", F.md5(X.scrubbed(F.col("text"), F.col("g"))).alias("scrubbed_md5"))


@query()
def answer_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-bounded masking looks behind, which the oracle's expressions can't; tests hold it against Python."""
    d = table(spark, sf_dir, "documents").withColumn("g", F.regexp_extract("text", "[A-Za-z]+", 0))
    out = X.masked(F.col("text"), F.col("g"))
    return d.select("doc_id", F.md5(out).alias("masked_md5"), ((F.length(out) - F.length(F.replace(out, F.lit(X.MASK)))) / F.lit(len(X.MASK))).cast("long").alias("n_masked"))


@query("""SELECT doc_id, md5(CASE WHEN length(text) <= 1000 THEN text ELSE substr(text, 1, 700) || chr(10) || '... [TRUNCATED ' || (length(text) - 900) || ' CHARS] ...' || chr(10) || right(text, 200) END) AS cut_md5 FROM documents""")
def trace_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.head_tail(F.col("text"), 1000, empty=None)).alias("cut_md5"))


@query(f"""SELECT doc_id, CAST(u.i AS BIGINT) AS unit_index, md5(u.x) AS unit_md5 FROM (SELECT doc_id, unnest(list_transform(CASE WHEN len(l) > 0 THEN l WHEN text <> '' THEN [{_strip("text")}] ELSE [] END, lambda x, i: {{'i': i - 1, 'x': x}})) AS u FROM
 (SELECT doc_id, text, list_filter(list_transform(string_split_regex(text, '[。！？!?；;：:.\\n]+'), lambda s: {_strip("s")}), lambda s: s <> '') AS l FROM documents))""")
def sentence_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.units(F.col("text"))).alias("i", "x"))
    return d.select("doc_id", F.col("i").cast("long").alias("unit_index"), F.md5("x").alias("unit_md5"))


@query(f"""SELECT doc_id, CAST(len(l) AS BIGINT) AS n_chunks, md5(array_to_string(l, '|')) AS chunks_md5 FROM (SELECT doc_id, list_filter(list_transform(range(5), lambda i: {_strip("substr(text, CAST(round_even(i * length(text) / CAST(5 AS DOUBLE), 0) AS INT) + 1, CAST(round_even((i + 1) * length(text) / CAST(5 AS DOUBLE), 0) AS INT) - CAST(round_even(i * length(text) / CAST(5 AS DOUBLE), 0) AS INT))")}), lambda s: s <> '') AS l FROM documents)""")
def equal_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("l", X.equal_chunks(F.col("text"), 5))
    return d.select("doc_id", F.size("l").cast("long").alias("n_chunks"), F.md5(F.array_join("l", "|")).alias("chunks_md5"))


_COUNT = "len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> ''))"


@query(f"SELECT doc_id, CAST({_COUNT} AS BIGINT) AS n_tokens FROM documents WHERE 64 + {_COUNT} + 256 <= 700")
def token_budget_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("n", X.token_count(F.col("text")))
    return d.where(64 + F.col("n") + 256 <= 700).select("doc_id", F.col("n").cast("long").alias("n_tokens"))


@query(f"SELECT doc_id, CAST(64 + {_COUNT} + 256 AS BIGINT) AS total, CAST(700 AS BIGINT) AS max_model_len, 'too_long' AS note FROM documents WHERE 64 + {_COUNT} + 256 > 700")
def token_budget_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("total", (64 + X.token_count(F.col("text")) + 256).cast("long")).where("total > 700")
    return d.select("doc_id", "total", F.lit(700).cast("long").alias("max_model_len"), F.lit("too_long").alias("note"))


# The roles as they are defined, in the oracle's own syntax: every word of every role is tried.
_ROLE_WORDS = (
    ("plan", "plan strategy let's lets we_will we_shall first next then step approach assume"), ("introduce", "let denote define set"), ("derive", "= >= != \\\\frac \\\\cdot \\\\div \\\\Rightarrow"),
    ("substitute", "substitute plug"), ("intermediate", "obtain get compute simplify simplifies combine rearrange collect expand"), ("check", "verify check plug_in substitution"),
    ("conclude", "therefore thus hence consequently in_conclusion final_answer answer_is"), ("derive", "a+b a/b x^2 \\\\sqrt \\\\theta"), ("other", "blue almost planning settle"),
)
_WORDS = [w.replace("_", " ").replace("\\\\", "\\") for _, words in _ROLE_WORDS for w in words.split()]
_sql_list = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


@query(f"""SELECT p_partkey, w AS word, CASE WHEN regexp_matches(w, '(?i)\\b(plan|strategy|let''?s|we (will|shall)|first|next|then|step|approach|assume)\\b') THEN 'plan' WHEN regexp_matches(w, '(?i)\\b(let|denote|define|set)\\b') THEN 'introduce'
 WHEN regexp_matches(w, '=|\\\\Rightarrow|≥|≤|!=|\\\\approx|\\\\sim|\\\\frac|\\\\cdot|\\\\times|\\\\div') THEN 'derive' WHEN regexp_matches(w, '(?i)\\b(substitute|plug)\\b') THEN 'substitute'
 WHEN regexp_matches(w, '(?i)\\b(obtain|get|compute|simplif(y|ies)|combine|rearrange|collect|expand)\\b') THEN 'intermediate' WHEN regexp_matches(w, '(?i)\\b(verify|check|plug\\s+in|substitute\\s+back|substitution)\\b') THEN 'check'
 WHEN regexp_matches(w, '(?i)\\b(therefore|thus|hence|consequently|in conclusion|final answer|answer is)\\b') THEN 'conclude'
 WHEN regexp_matches(w, '[=+*/^-]|\\\\frac|\\\\sqrt|\\\\sum|\\\\int|\\\\prod|\\\\lim|\\\\binom|\\\\alpha|\\\\beta|\\\\gamma|\\\\pi|\\\\theta') THEN 'derive' ELSE 'other' END AS role
 FROM (SELECT p_partkey, {_sql_list(_WORDS)}[1 + p_partkey % {len(_WORDS)}] || ' ' || split_part(p_name, ' ', 1) AS w FROM part)""")
def role_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*map(F.lit, _WORDS))
    p = table(spark, sf_dir, "part").withColumn("word", F.concat(F.get(words, (F.col("p_partkey") % len(_WORDS)).cast("int")), F.lit(" "), F.substring_index("p_name", " ", 1)))
    return p.select("p_partkey", "word", X.role(F.col("word")).alias("role"))


@query("""SELECT doc_id, CAST(regexp_matches(text, '=|\\\\Rightarrow|≥|≤|!=|\\\\approx|\\\\sim|\\\\frac|\\\\cdot|\\\\times|\\\\div') AS INT) AS has_equation,
 CAST(regexp_matches(text, '[=+*/^-]|\\\\frac|\\\\sqrt|\\\\sum|\\\\int|\\\\prod|\\\\lim|\\\\binom|\\\\alpha|\\\\beta|\\\\gamma|\\\\pi|\\\\theta') AS INT) AS is_symbolic,
 CAST(regexp_matches(text, '(?i)\\b(therefore|thus|hence|consequently|in conclusion|final answer|answer is)\\b') AS INT) AS is_conclusion, CAST(regexp_matches(text, '(?i)\\b(verify|check|plug\\s+in|substitute\\s+back|substitution)\\b') AS INT) AS is_check,
 CAST(regexp_matches(text, '(?i)^\\s*(ok(ay)?|hmm+|let me|now|wait|note that|remember|i need to|i should|maybe|well|alright)\\b') AS INT) AS is_meta,
 CAST(regexp_matches(text, '(?i)^\\s*(simplify|which simplifies|combine like terms|so now|now we have|therefore we can write|thus)\\b') AS INT) AS is_continuation, CAST(contains(text, '\\boxed') AS INT) AS has_boxed FROM documents""")
def sentence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *[c.cast("int").alias(n) for n, c in X.flags(F.col("text")).items()])


@query("""SELECT source, string_agg(md5(text), ',' ORDER BY first_id) AS texts, CAST(count(*) AS BIGINT) AS n FROM (SELECT source, text, min(doc_id) AS first_id FROM documents GROUP BY source, text) GROUP BY source""")
def text_dedup_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy("source", "text").agg(F.min("doc_id").alias("first_id")).select("source", "first_id", F.md5("text").alias("m"))
    d = d.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("first_id", "m"))).alias("l"))
    return d.select("source", F.array_join(F.transform("l", lambda x: x["m"]), ",").alias("texts"), F.size("l").cast("long").alias("n"))


@query("""WITH s AS (SELECT doc_id, u.i AS mid, CAST(len(l) AS DOUBLE) AS n, u.x AS x FROM (SELECT doc_id, l, unnest(list_transform(l, lambda x, i: {'i': i, 'x': x})) AS u FROM
 (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda s: s <> '') AS l FROM documents))), f AS (SELECT doc_id, mid, round(least(CAST(1 AS DOUBLE), CAST(0.2 AS DOUBLE) * (mid / n) + CAST(0.15 AS DOUBLE) * least(CAST(1 AS DOUBLE), length(x) / CAST(120 AS DOUBLE))), 3) AS score FROM s)
SELECT doc_id, CAST(mid AS BIGINT) AS mid, score FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, mid) <= 3""")
def topk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda s: s != "")
    d = table(spark, sf_dir, "documents").select("doc_id", F.size(lines).cast("double").alias("n"), F.posexplode(lines).alias("i", "x")).withColumn("mid", (F.col("i") + 1).cast("long"))
    d = d.withColumn("score", A.cheap_score(F.col("mid") / F.col("n"), F.length("x"), F.lit(0.0)))
    return d.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "mid"))).where("rn <= 3").select("doc_id", "mid", "score")
