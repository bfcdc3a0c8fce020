"""Queries over record lines, generations, summaries and samples. Their JSON lines and lists are built from documents and conversations; the SQL says what
must come out, by the rules of the record formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import prompts as P
from ..functions import text as X
from ..operators import ablation as B
from ..operators import extract as E
from ..operators import importance as I
from ..operators import joins as J
from ..operators import records as R
from ..operators import segment as G
from ..operators import similarity as Y
from ..operators.scoring import empty_scorer, score
from ..sources.io import first_rows
from .registry import query, table

_S = r"regexp_replace({}, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')"
_T = _S.format("text")
_N = "len(list_filter(string_split_regex({}, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> ''))"
_NORMAL = _S.format(r"regexp_replace(regexp_replace(replace({}, chr(13), chr(10)), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")
_TN = _NORMAL.format("text")
_lit = lambda s: "'" + s.replace("'", "''") + "'"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))


_DOCS = "(SELECT * REPLACE (coalesce(text, '') AS text) FROM documents)"


def _json(*cols: Column) -> Column:
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS id, md5(CASE k WHEN 2 THEN {_S.format("text || chr(10) || 'more'")} WHEN 5 THEN '' ELSE {_T} END) AS prompt_md5, md5(CASE k WHEN 0 THEN 'a' || doc_id WHEN 1 THEN 'o' WHEN 2 THEN {_T} WHEN 3 THEN 'm' WHEN 4 THEN 'k: v' ELSE '' END) AS answer_md5,
 CAST(CASE k WHEN 0 THEN doc_id WHEN 1 THEN 7 WHEN 3 THEN 2 WHEN 4 THEN 3 END AS DOUBLE) AS reasoning_token_count, CASE WHEN k < 2 THEN lang END AS domain, CASE WHEN k = 0 THEN source END AS provider_id FROM (SELECT *, doc_id % 6 AS k FROM {_DOCS})""")
def unified_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record lines of six shapes: plain keys, aliases, a chat of mixed turns, metadata with a null target, values that are no strings, and nothing."""
    i, t = F.col("doc_id").cast("string").alias("id"), F.col("text")
    chat = F.concat_ws(",", _json(*turn_cols(role=F.lit("User"), content=t)), _json(*turn_cols(speaker=F.lit("human"), text=F.lit("more"))), F.lit('{"role":"assistant","content":["x","y"]}'), _json(*turn_cols(role=F.lit("bot"), value=t)))
    lines = [
        _json(i, t.alias("prompt"), F.concat(F.lit("a"), i).alias("final_answer"), F.col("doc_id").alias("reasoning_token_count"), F.col("lang").alias("domain"), F.col("source").alias("provider_id")),
        _json(i, F.lit("  ").alias("question"), t.alias("query"), F.lit("o").alias("output"), F.lit(7).alias("reasoning_len"), F.col("lang").alias("task_type")),
        F.concat(F.lit('{"id":"'), i, F.lit('","messages":['), chat, F.lit("]}")),
        _json(i, F.struct(t.alias("problem"), F.lit("m").alias("gt_answer")).alias("meta"), F.lit(None).cast("int").alias("reasoning_token_count"), F.lit(5).alias("reasoning_tokens"), F.lit("one two").alias("think")),
        _json(i, F.lit(5).alias("input"), t.alias("task"), F.expr("array(named_struct('role', 'system', 'content', named_struct('k', 's')), named_struct('role', 'tool', 'content', named_struct('k', 'v')))").alias("chat"), F.array(F.lit("a b"), F.lit("c")).alias("thoughts")),
        _json(i),
    ]
    k, line = F.col("doc_id") % 6, F.lit(None).cast("string")
    for n, x in enumerate(lines):
        line = F.when(k == n, x).otherwise(line)
    out = R.unified(_docs(spark, sf_dir).select(line.alias("line")), "line", infer=True)
    return out.select("id", F.md5("prompt").alias("prompt_md5"), F.md5("final_answer").alias("answer_md5"), "reasoning_token_count", "domain", "provider_id")


def turn_cols(**named: Column) -> list[Column]:
    return [c.alias(n) for n, c in named.items()]


@query(f"""SELECT doc_id, md5({_T}) AS prompt_md5, CASE WHEN k = 0 THEN 'tail' ELSE 'plain' END AS final_answer, CAST({_N.format("text")} AS BIGINT) AS n_in, CAST(1 AS BIGINT) AS n_out, CAST(CASE WHEN k = 0 THEN {_N.format("text")} ELSE 3 END AS BIGINT) AS reasoning_token_count FROM (SELECT *, doc_id % 3 AS k FROM {_DOCS}) WHERE k < 2""")
def hf_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    d = _docs(spark, sf_dir).select("doc_id", "text", F.when(k == 0, F.concat(F.lit("<think>"), "text", F.lit("</think> tail "))).otherwise(" plain").alias("a"), F.when(k == 1, " r s t ").alias("r"))
    out = R.from_dataset(d, "text", "a", "r", require_think=True)
    return out.select("doc_id", F.md5("prompt").alias("prompt_md5"), "final_answer", *[F.col(c).cast("long").alias(c) for c in ("n_in", "n_out", "reasoning_token_count")])


@query("SELECT event_id, value AS y FROM events WHERE value IS NOT NULL")
def known_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("reasoning_tokens"))
    return R.with_target(e.select("event_id", R.target(e).alias("y")), "y")


@query(f"""SELECT doc_id, gen_index, md5(x) AS text_md5, CASE gen_index WHEN 0 THEN 'stop' END AS finish_reason FROM (SELECT doc_id, CAST(0 AS BIGINT) AS gen_index, CASE WHEN doc_id % 2 = 0 THEN {_TN} ELSE {_NORMAL.format(_T)} END AS x FROM {_DOCS} WHERE {_TN} <> ''
 UNION ALL SELECT doc_id, CASE WHEN {_TN} <> '' THEN 1 ELSE 0 END, 'plain' FROM {_DOCS} WHERE doc_id % 2 = 0)""")
def generation_reasonings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    gens = F.when(F.col("doc_id") % 2 == 0, F.array(F.concat(F.lit("<THINK> "), "text", F.lit(" </think> z")), F.lit("plain"), F.lit("  ")))
    d = d.select("doc_id", F.posexplode(E.reasonings(gens, F.col("text"))).alias("gi", "x"))
    return d.select("doc_id", F.col("gi").cast("long").alias("gen_index"), F.md5("x").alias("text_md5"), E.finish_reason(F.array(F.lit("stop")), F.col("gi")).alias("finish_reason"))


_FIELDS = f"(SELECT doc_id, doc_id % 4 AS k, {_TN} AS t FROM {_DOCS})"
_TRACES = f"SELECT doc_id, 'M' AS mode, 'traces_natural' AS source, 't one' AS x FROM {_FIELDS} WHERE @ UNION ALL SELECT doc_id, 'M', 'traces_natural', t FROM {_FIELDS} WHERE @ AND t <> ''"
_FIRST = f"SELECT doc_id, 'M' AS mode, 'summary_trace_augmented' AS source, t AS x FROM {_FIELDS} WHERE k = 0 AND t <> ''"


@query(f"""SELECT doc_id, mode, source, md5(x) AS text_md5 FROM ({_FIRST.replace("'M'", "'summary'")} UNION ALL SELECT doc_id, 'summary', 'summary_answer_driven', 'a' FROM {_FIELDS} WHERE k = 1 UNION ALL {_TRACES.replace("'M'", "'summary'").replace("@", "k >= 2")}
 UNION ALL {_FIRST.replace("'M'", "'traces'")} UNION ALL {_TRACES.replace("'M'", "'traces'").replace("@", "k >= 1")} UNION ALL SELECT doc_id, 'solution', 'solution', 'sol' FROM {_FIELDS})""")
def preferred_reasonings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    summary = F.when(k == 0, F.when(F.col("t") != "", F.col("text")).otherwise(F.lit("<think> </think>")))
    d = _docs(spark, sf_dir).withColumn("t", X.normalised(F.col("text")))
    fields = (summary, F.when(k == 1, F.lit("<think> a </think> b")), F.when(k >= 1, F.array(F.lit("t  one"), F.lit(" "), F.col("text"))), F.lit(" sol "))
    found = [d.select("doc_id", F.lit(m).alias("mode"), F.inline(E.preferred(*fields, prefer=m))) for m in ("summary", "traces", "solution")]
    out = found[0].unionByName(found[1]).unionByName(found[2])
    return out.select("doc_id", "mode", "source", F.md5("text").alias("text_md5"))


@query(f"""SELECT CASE WHEN doc_id % 5 = 0 THEN 'general-' || doc_id ELSE CAST(doc_id % 5 AS VARCHAR) END AS uid, doc_id, CAST(gi AS BIGINT) AS gen_index, md5(x) AS summary_md5 FROM (SELECT doc_id, 0 AS gi, {_TN} AS x FROM {_DOCS} WHERE doc_id % 3 < 2 AND {_TN} <> ''
 UNION ALL SELECT doc_id, CASE WHEN {_TN} <> '' THEN 1 ELSE 0 END, 'b' FROM {_DOCS} WHERE doc_id % 3 = 0)""")
def summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = F.col("doc_id") % 3, F.lit(None).cast("string")
    first = E.as_list(F.when(k == 0, "  "))
    several = E.as_list(none, F.when(k == 0, F.array(F.col("text"), F.lit(" "), F.lit("b"))))
    one = E.as_list(F.when(k == 1, F.col("text")))
    uid = R.identified(F.col("doc_id"), none, F.lit(""), F.col("doc_id") % 5)
    d = _docs(spark, sf_dir).select(uid.alias("uid"), "doc_id", F.posexplode(E.summaries([first, several, one])).alias("gi", "x"))
    return d.select("uid", "doc_id", F.col("gi").cast("long").alias("gen_index"), F.md5("x").alias("summary_md5"))


@query(f"SELECT doc_id, CAST(3 AS BIGINT) AS n_traces, md5('a' || chr(10) || '----- TRACE -----' || chr(10) || {_T} || chr(10) || '----- TRACE -----' || chr(10) || 'b') AS joined_md5 FROM {_DOCS} WHERE {_T} NOT IN ('a', 'b') UNION ALL SELECT doc_id, 2, md5('a' || chr(10) || '----- TRACE -----' || chr(10) || 'b') FROM {_DOCS} WHERE {_T} IN ('a', 'b')")
def distinct_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    gens = F.array(F.concat(F.lit("<think> a </think><THINK>"), "text", F.lit("</THINK>")), F.lit("<think>a</think>"), F.lit("none"))
    d = _docs(spark, sf_dir).withColumn("l", E.traces(gens, F.lit("<think>b </think>")))
    return d.select("doc_id", F.size("l").cast("long").alias("n_traces"), F.md5(E.joined_traces(F.col("l"))).alias("joined_md5"))


def _prompt_sql(kind: str, problem: str, hints: str, answer: str, shown: bool = False) -> str:
    system, user = P.TEMPLATES[kind]
    user = P.SUMMARY_USER_ANSWER if shown else user
    body = _lit(user).replace("{problem}", f"' || {problem} || '").replace("{hints}", f"' || {hints} || '").replace("{answer}", f"' || {answer} || '")
    return f"'[SYSTEM]' || chr(10) || {_lit(system)} || chr(10) || chr(10) || {body} || chr(10) || chr(10) || 'Assistant:'"


@query(" UNION ALL ".join(f"SELECT doc_id, '{kind}' AS kind, md5({_prompt_sql(kind, 'text', 'source', 'lang')}) AS prompt_md5 FROM (SELECT doc_id, text, coalesce(source, '') AS source, coalesce(lang, '') AS lang FROM {_DOCS})" for kind in P.TEMPLATES)
       + f" UNION ALL SELECT doc_id, 'summary with answer', md5({_prompt_sql('summary', 'text', 'source', 'lang', True)}) FROM (SELECT doc_id, text, coalesce(source, '') AS source, lang FROM {_DOCS} WHERE lang <> '')")
def prompt_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", "text", "source", "lang")
    made = [F.struct(F.lit(k).alias("kind"), P.chat_prompt(k, F.col("text"), F.col("source"), F.col("lang")).alias("p")) for k in P.TEMPLATES]
    shown = F.struct(F.lit("summary with answer").alias("kind"), F.when(F.coalesce("lang", F.lit("")) != "", P.chat_prompt("summary", F.col("text"), F.col("source"), F.col("lang"), True)).alias("p"))
    return d.select("doc_id", F.inline(F.array(*made, shown))).where("p is not null").select("doc_id", "kind", F.md5("p").alias("prompt_md5"))


_STEPS = "SELECT conv_id, list(text ORDER BY turn) AS l FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE turn > 0) GROUP BY conv_id"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns after the first are steps, with a blank one; the first turn is the problem, and of two records for a key the later wins."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    steps = c.where("turn > 0").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l")).select("conv_id", F.concat(F.transform("l", lambda x: x["text"]), F.array(F.lit(" "))).alias("steps"))
    first = c.where("turn = 0").select("conv_id", F.col("text").alias("question"), F.lit("").alias("final_answer"), F.lit("gold").alias("answer_gold"), F.lit(1).alias("at"))
    raw = first.unionByName(first.withColumns({"question": F.lit("old"), "at": F.lit(0)}))
    return B.aligned(steps, raw, ["conv_id"], [F.desc("at")], ("final_answer", "answer_gold"), not_blank=True)


@query(f"SELECT s.conv_id, md5(c.text) AS problem_md5, 'gold' AS gold_answer, CAST(len(k) AS BIGINT) AS n_steps, md5(array_to_string(k, chr(10))) AS trace_md5 FROM (SELECT conv_id, list_filter(l, lambda x: {_S.format('x')} <> '') AS k FROM ({_STEPS})) s JOIN (SELECT conv_id, coalesce(text, '') AS text FROM conversations WHERE turn = 0) c USING (conv_id) WHERE len(k) > 0")
def aligned_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _samples(spark, sf_dir)
    return s.select("conv_id", F.md5("problem").alias("problem_md5"), "gold_answer", F.size("steps").cast("long").alias("n_steps"), F.md5("full_trace").alias("trace_md5"))


@query(f"SELECT s.conv_id, CAST({_N.format(_prompt_sql('general', 'c.text', _lit(''), _lit('')))} AS BIGINT) AS empty_prompt_tokens, 'problem_too_long' AS reason, CAST(100 AS BIGINT) AS ctx_budget FROM ({_STEPS}) s JOIN (SELECT conv_id, coalesce(text, '') AS text FROM conversations WHERE turn = 0) c USING (conv_id) WHERE {_N.format(_prompt_sql('general', 'c.text', _lit(''), _lit('')))} > 100 AND len(list_filter(l, lambda x: {_S.format('x')} <> '')) > 0")
def impossible_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.with_budget(_samples(spark, sf_dir), "general", 100)[1]


@query()
def ablation_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads and tails are fitted step by step; a brute-force test stands for SQL."""
    fits, _ = B.with_budget(_samples(spark, sf_dir), "general", 160)
    t = B.tasks(fits, "general", 160)
    return t.select("conv_id", "variant", "step_index", "problem", "gold_answer", "hints", "prompt", "n_head", "n_tail", "n_cut")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id IS NOT NULL AND user_id IS NOT NULL AND value IS NOT NULL AND event_type = 'click'")
def complete_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").withColumn("granularity", F.col("event_type"))
    return B.complete(log, ("event_id", "user_id", "value"), "click").select("event_id", "user_id", "event_type")


@query("""WITH k AS (SELECT l_orderkey, l_linenumber - 2 AS s, arg_max(l_quantity, {'a': l_partkey, 'b': l_suppkey, 'c': l_extendedprice, 'd': l_shipdate}) AS v FROM lineitem GROUP BY l_orderkey, l_linenumber), r AS (SELECT l_orderkey, max(s) AS n FROM k WHERE s >= 0 GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(list_transform(range(0, n + 1), lambda i: coalesce((m[i])::VARCHAR, '0.0')), ',') AS vector FROM r JOIN (SELECT l_orderkey, map_from_entries(list({'k': s, 'v': CAST(v AS DOUBLE)})) AS m FROM k WHERE s >= 0 GROUP BY l_orderkey) USING (l_orderkey)""")
def importance_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of an order by line number, the last of repeated lines; steps without a line are 0."""
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 2).cast("int").alias("s"), F.col("l_quantity").cast("double").alias("v"), F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").alias("at"))
    d = d.where("s >= 0").withColumn("variant", F.concat(F.lit("drop_"), F.col("s").cast("string")))
    d = I.dense(I.grouped(d, ["l_orderkey"], "at"), ["l_orderkey"], "s", "v")
    return d.select("l_orderkey", F.array_join(F.transform("vector", lambda x: x.cast("string")), ",").alias("vector"))


@query(f"""SELECT doc_id, CASE k WHEN 0 THEN 'old-' || doc_id WHEN 1 THEN 'p-' || (doc_id - 1) END AS summary FROM (SELECT doc_id, doc_id % 4 AS k FROM {_DOCS}) WHERE k <> 1 OR doc_id - 1 IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, NULL FROM {_DOCS} WHERE doc_id % 4 = 1 AND doc_id - 1 NOT IN (SELECT doc_id FROM documents)""")
def summary_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys by presence: k = 0 has uuid and gen_index, 1 the prompt of the document before, 2 a null id (which is a kind of its own), 3 a uuid alone."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    i, k = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    of = lambda **kv: F.map_from_arrays(F.array(*map(F.lit, kv)), F.array(*[v.cast("string") for v in kv.values()]))
    null = F.lit(None).cast("string")
    record = F.when(k == 0, of(uuid=i, gen_index=F.lit(0))).when(k == 1, of(question=(F.col("doc_id") - 1).cast("string"))).when(k == 2, of(id=null, uuid=i)).otherwise(of(uuid=i))
    rows = d.select("doc_id", J.presence_key(record).alias("key"))
    zero = d.where("doc_id % 4 = 0")
    by_id = zero.select(J.presence_key(of(uuid=i, gen_index=F.lit(0))).alias("key"), F.concat(F.lit("old-"), i).alias("summary"), F.lit(1).alias("at"))
    made = by_id.unionByName(by_id.withColumns({"summary": F.lit("new"), "at": F.lit(0)})).unionByName(zero.select(J.presence_key(of(prompt=i)).alias("key"), F.concat(F.lit("p-"), i).alias("summary"), F.lit(0).alias("at")))
    made = made.unionByName(d.where("doc_id % 4 = 3").select(J.presence_key(of(uuid=i)).alias("key"), F.lit("  ").alias("summary"), F.lit(0).alias("at")))
    return J.attached(rows, made, "key", "summary", [F.desc("at")]).select("doc_id", "summary")


@query(f"""SELECT doc_id, md5('Prompt:' || chr(10) || text || chr(10) || chr(10) || 'Answer:' || chr(10) || 'seen' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || 'Summary:' || chr(10) || 'short one' ELSE '' END) AS input_md5 FROM {_DOCS}""")
def model_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", "text", F.lit("<think>x</think> seen ").alias("answer"), F.when(F.col("doc_id") % 2 == 0, " short one ").otherwise(" ").alias("s"))
    return d.select("doc_id", F.md5(X.model_input(F.col("text"), R.visible_answer(d), F.col("s"))).alias("input_md5"))


@query()
def packed_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt, answer and summary cut to 64 words between them; a brute-force test stands for SQL."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(*[F.max(F.when(F.col("turn") == i, F.col("text"))).alias(n) for i, n in enumerate(("a", "b", "c"))])
    c = c.fillna("")
    return c.select("*", X.model_input(F.col("a"), F.col("b"), F.col("c"), 64).alias("packed"))


@query("""SELECT doc_id, CASE k WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS is_correct, CASE k WHEN 0 THEN 'math_verify' WHEN 1 THEN 'llama_judge' WHEN 4 THEN 'unknown' ELSE 'string_match' END AS verified_by FROM (SELECT doc_id, doc_id % 5 AS k FROM documents)""")
def answer_correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = F.col("doc_id") % 5, F.lit(None).cast("boolean")
    answer = F.when(k == 2, F.lit("\\boxed{7}")).when(k == 4, F.lit(None)).otherwise("8")
    out = G.correctness(answer, F.lit(" 7 "), F.when(k == 0, F.lit(True)).otherwise(none), F.when(k <= 1, F.lit(False)).otherwise(none))
    return table(spark, sf_dir, "documents").select("doc_id", out.alias("c")).select("doc_id", "c.*")


@query("""SELECT label, CAST(i AS BIGINT) AS i, round(CASE WHEN t > 0 THEN x / t ELSE CAST(1 AS DOUBLE) / 5 END, 9) AS w FROM (SELECT label, id, i, x, sum(x) OVER (PARTITION BY id) AS t FROM (SELECT label, id, i, CASE WHEN i <= 3 THEN CAST(embedding[i] AS DOUBLE) ELSE CAST(1e-8 AS DOUBLE) END AS x FROM (SELECT label, vec_id AS id, embedding, unnest(range(1, 6)) AS i FROM embeddings)))""")
def weights_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    w = A.weights_to_length(F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")), F.lit(5))
    return e.select("label", F.posexplode(w).alias("i", "w")).select("label", (F.col("i") + 1).cast("long").alias("i"), F.round("w", 9).alias("w"))


@query(f"SELECT doc_id, '' AS summary, md5({_prompt_sql('tutor', 'text', _lit('(none)'), _lit('a'))}) AS prompt_md5 FROM {_DOCS}")
def generated_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary stage with the engine that stands in offline: every output is empty."""
    d = _docs(spark, sf_dir)
    d = d.select("doc_id", P.chat_prompt("tutor", F.col("text"), X.head_tail(E.joined_traces(E.traces(F.lit(None).cast("array<string>"), F.lit(""))), 6000), F.lit("a")).alias("prompt"))
    return score(d, "prompt", empty_scorer).select("doc_id", X.summary_text(F.col("output")).alias("summary"), F.md5("prompt").alias("prompt_md5"))


@query("SELECT event_type, count(*) AS total, count(value) AS kept, count(*) - count(value) AS skipped FROM events GROUP BY event_type")
def row_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a filter, by group; sources.io.counted observes the same while a stage runs."""
    ok = F.col("value").isNotNull()
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("kept"), F.count_if(~ok).alias("skipped"))


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 50")
def first_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-N of a dataset: the limit is the feature."""
    return first_rows(table(spark, sf_dir, "documents").select("doc_id", "source"), 50, "doc_id")


@query()
def macro_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps with their features, and the three of highest score; an independent model in the tests stands for SQL."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_extract("text", "[A-Za-z]+", 0).alias("gold"))
    return G.macro_rows(d, "doc_id", "text", most=G.MOST, gold="gold", top=3)


@query()
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of assistant turns by user turns, weighted by their words, worst first; a brute-force test stands for SQL."""
    c = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    u = c.select("conv_id", F.when(F.col("role") == "user", "s").otherwise("t").alias("side"), F.col("turn").alias("idx"), F.coalesce("text", F.lit("")).alias("text"))
    w = u.select("conv_id", "side", "idx", X.token_count(F.col("text")).cast("double").alias("w"))
    return Y.coverage_report(u, w, "conv_id")
