"""Samples, sources and splits against plain Python on small tables."""

import json
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright import catalog
from tracewright.functions.python import flattened
from tracewright.operators import ablation as B
from tracewright.operators import importance as I
from tracewright.operators import records as R
from tracewright.operators import split as S
from tracewright.sources import io

SF = "/root/testdata/sf0.001"
run = lambda spark, name: catalog.queries()[name](spark, SF)


def fitted(problem, steps, budget, always=False):
    """Heads, then tails, by counting the words of the whole prompt each time."""
    fixed = len(problem.split()) + 57 - 57
    n = lambda hints: fixed + len(hints.split())
    if n("\n".join(steps)) <= budget:
        return "\n".join(steps), len(steps), 0
    head, tail, rest = [], [], list(steps)
    while rest and n(" ".join([*head, rest[0], "<...>"])) <= budget:
        head.append(rest.pop(0))
    while rest and n(" ".join([*head, "<...>", rest[-1], *tail])) <= budget:
        tail.insert(0, rest.pop())
    return "\n".join([*head, *(["<...>"] if (head or tail) and (rest or always) else []), *tail]), len(head), len(tail)


def test_tasks(spark):
    samples = B.with_budget(spark.createDataFrame([(1, "p q", "", ["a b c", "d e", "f", "g h i j"]), (2, "p", "", []), (3, "x " * 500, "", ["a"])], "id long, problem string, gold_answer string, steps array<string>").withColumn("full_trace", F.lit("")), "general", 0)[1]
    base = {r.id: r.empty_prompt_tokens for r in samples.collect()}
    df = spark.createDataFrame([(1, "p q", "", ["a b c", "d e", "f", "g h i j"]), (2, "p", "", []), (3, "x " * 500, "", ["a"])], "id long, problem string, gold_answer string, steps array<string>").withColumn("full_trace", F.lit(""))
    budget = base[1] + 6
    ok, log = B.with_budget(df, "general", budget)
    assert [r.id for r in log.collect()] == [3]
    for always in (False, True):
        got = {(r.id, r.variant): r for r in B.tasks(ok, "general", budget, gap_always=always).collect()}
        for (i, v), r in got.items():
            steps = {1: ["a b c", "d e", "f", "g h i j"], 2: []}[i]
            steps = steps if v == "base" else [x for k, x in enumerate(steps) if v != f"drop_{k}"]
            hints, head, tail = fitted("p q" if i == 1 else "p", steps, budget - base[i] + (2 if i == 1 else 1), always)
            assert (r.hints, r.n_head, r.n_tail) == (hints, head, tail) and len(r.prompt.split()) <= budget
    assert {r.id: len(r.truncated_variants) for r in B.truncated_log(B.tasks(ok, "general", budget), ["id"]).collect()} == {1: len([1 for (i, v), r in got.items() if i == 1 and r.n_cut > 0])}
    t = run(spark, "ablation_tasks").toPandas()
    assert len(t) and (t["n_cut"] >= 0).all() and (t["prompt"].map(lambda p: len(p.split())) <= 160).all()


def test_packed(spark):
    for r in run(spark, "packed_inputs").collect():
        a, b, c = (f"{n}:\n{x}".split() for n, x in (("Prompt", r.a), ("Answer", r.b), ("Summary", r.c.strip())))
        if not r.c.strip():
            assert r.packed == f"Prompt:\n{r.a}\n\nAnswer:\n{r.b}"
            continue
        cap = 56
        q = [min(len(x), max(8, cap * s // 10)) for x, s in zip((a, b, c), (4, 4, 2), strict=True)]
        left = cap - sum(q)
        while left > 0 and (more := max(len(x) - n for x, n in zip((a, b, c), q, strict=True))) > 0:
            i = [len(x) - n for x, n in zip((a, b, c), q, strict=True)].index(more)
            q[i] += min(left, more)
            left -= min(left, more)
        assert r.packed == "\n\n".join(" ".join(x[:n]) for x, n in zip((a, b, c), q, strict=True))


def test_coverage(spark):
    """The report against NumPy."""
    import re

    got = {r.conv_id: r for r in run(spark, "coverage_report").collect()}
    by = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        if r.role in ("user", "assistant"):
            by.setdefault(r.conv_id, {"user": [], "assistant": []})[r.role].append(r.text or "")
    by = {k: (v["user"], v["assistant"]) for k, v in by.items() if v["user"] and v["assistant"]}
    assert set(by) == set(got)
    for k, (s, t) in by.items():
        docs = [Counter(re.findall(r"\b\w\w+\b", x.lower())) for x in s + t]
        df = Counter(w for d in docs for w in d)
        vecs = []
        for d in docs:
            v = {w: n * (math.log((1 + len(docs)) / (1 + df[w])) + 1) for w, n in d.items() if df[w] <= 0.95 * len(docs)}
            norm = math.sqrt(sum(x * x for x in v.values())) or 1
            vecs.append({w: x / norm for w, x in v.items()})
        m = np.array([[min(1, sum(x * b.get(w, 0) for w, x in a.items())) for b in vecs[len(s) :]] for a in vecs[: len(s)]])
        e = np.where(m > 0.05, np.exp(m / 0.25), 0)
        align = e / np.maximum(e.sum(1, keepdims=True), 1e-300)
        weight = lambda xs: np.array([len(x.split()) for x in xs], float)
        even = lambda w: w / w.sum() if w.sum() > 0 else np.full(len(w), 1 / len(w))
        ws, wt = even(weight(s)), even(weight(t))
        covered = np.minimum(1, align.sum(0))
        order, total, top = np.argsort(-wt, kind="stable"), 0.0, []
        for i in order:
            if total >= 0.2 - 1e-12:
                break
            total += wt[i]
            top.append(i)
        share = (wt[top] * covered[top]).sum() / wt[top].sum() if top else 0
        low = m.max(1) < 0.2
        assert [got[k][c] for c in ("wcov", "wcov_top", "miss_top", "unmatched_ratio", "extraneous_salience")] == pytest.approx([(wt * covered).sum(), share, 1 - share, low.mean(), ws[low].sum()], abs=1e-6)


def test_macro_features(spark):
    d = run(spark, "macro_features").toPandas()
    assert set(d["role"]) <= {"plan", "introduce", "derive", "substitute", "intermediate", "check", "conclude", "other"}
    for _, g in d.sort_values("mid").groupby("doc_id"):
        assert g["mid"].tolist() == list(range(1, len(g) + 1)) and g["start_sid"].tolist()[1:] == [x + 1 for x in g["end_sid"].tolist()[:-1]]
        best = sorted(zip(-g["cheap_score"], g["mid"], strict=True))[:3]
        assert list(g["candidate_macro_ids"].iloc[0]) == [m for _, m in best]


def test_records(spark):
    lines = ['{"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}]}, {"role": "user", "content": " "}], "answer": " "}', '{"dialog": [{"content": "first"}, {"content": {"content": "last"}}]}', "not json", '{"prompt": " ", "reasoning_tokens": "x"}', '{"chat": []}']
    got = R.unified(spark.createDataFrame([(x,) for x in lines], "line string"), "line").toPandas()
    assert got["prompt"].tolist() == ["type: text\ntext: a", "first", "", "", ""] and got["final_answer"].tolist() == ["", "last", "", "", ""]
    assert flattened({"a": 1, "b": [None, "x"]}) == "a: 1\nb: \nx"
    df = spark.createDataFrame([(None, "4"), (None, "x"), ("2", "9")], "reasoning_token_count string, hidden_len string")
    assert [r[0] for r in df.select(R.target(df, missing=0.0)).collect()] == [4.0, 0.0, 2.0]
    with pytest.raises(Exception, match="missing target"):
        df.select(R.target(df, missing="raise")).collect()
    ids = spark.createDataFrame([(0, None, ""), (1, "u", "")], "n long, a string, b string")
    assert [r[0] for r in ids.select(R.identified(F.col("n"), F.col("a"), F.col("b"), prefix="rec_", width=6)).collect()] == ["rec_000000", "u"]


def test_importance_groups(spark):
    log = spark.createDataFrame([(1, "base", 1, 5.0), (1, "base", 2, 6.0), (1, "drop_0", 1, 1.0), (1, "drop_0", 2, 2.0), (1, "drop_2", 1, 9.0)], "k long, variant string, at int, avg_logp double")
    first, last = ({(r.variant): r.avg_logp for r in I.grouped(log, ["k"], "at", base=b).collect()} for b in ("first", "last"))
    assert first == {"base": 5.0, "drop_0": 2.0, "drop_2": 9.0} and last["base"] == 6.0
    d = I.logp_importance(I.grouped(log, ["k"], "at"), ["k"]).withColumn("s", F.substring_index("variant", "_", -1).cast("int"))
    assert [r.vector for r in I.dense(d, ["k"], "s", "importance").collect()] == [[4.0, 0.0, 0.0]]


def test_group_sample(spark):
    """Against a sequential pass over groups."""
    rows = [(i, g) for i, g in enumerate([g for g in range(40) for _ in range(1 + g % 7)] + [None] * 5)]
    df = spark.createDataFrame(rows, "i long, g long")
    ranks = [(r.g, r.rows) for r in S.group_ranks(df, "g", 3).orderBy("rank").collect()]
    assert len(ranks) == 41 and sum(n for _, n in ranks) == len(rows)
    for target in (1, 2, 30, 77, len(rows)):
        total, expect = 0, []
        for g, n in ranks:
            if total + n > target and total > 0:
                continue
            expect.append(g)
            total += n
            if total >= target:
                break
        got = [r.g for r in S.group_sample(df, "g", target, 3, ["i"]).collect()]
        assert len(got) == target
        size = dict(ranks)
        assert all(got.count(g) == size[g] for g in expect) or total > target
    assert (S.sample_size(10, 0.25), S.sample_size(10, 0.01), S.sample_size(10, 1.0, 4), S.sample_size(0), S.sample_size(10, 0.5, 3)) == (2, 1, 4, 0, 3)
    folds = S.kfold(df, "g", 4, 1).toPandas()
    assert len(folds) == 41 and folds["fold"].value_counts().to_dict() == {0.0: 10, 1.0: 10, 2.0: 10, 3.0: 10}


def test_sources(spark, tmp_path):
    (tmp_path / "a1.jsonl").write_text('{"id": "1", "question": "q"}\n\n{"uuid": null, "id": "2"}\n')
    (tmp_path / "a2.jsonl").write_text('{"id": "3"}\nbroken\n')
    at = str(tmp_path)
    assert io.jsonl(spark, f"{at}/a1.jsonl", "id string, question string").count() == 2
    assert sorted(r.id for r in io.jsonl(spark, f"{at}/a2.jsonl", "id string", strict=False).collect()) == ["3"]
    with pytest.raises(Exception, match="(?i)malformed"):
        io.jsonl(spark, f"{at}/a2.jsonl", "id string").collect()
    named = io.aliased(io.raw_json(spark, f"{at}/a1.jsonl"), {"uuid": "id", "problem": "question"})
    assert sorted((r.uuid or "", r.problem or "") for r in named.collect()) == [("", ""), ("1", "q")]
    spark.range(3).select(F.col("id").cast("string").alias("id")).write.parquet(f"{at}/p.parquet")
    assert io.sources(spark, [f"{at}/a1.jsonl", f"{at}/p.parquet/part*.parquet", f"{at}/none*.jsonl"], "id string").count() == 5
    assert io.sources(spark, [f"{at}/none*"], "id string").count() == 0
    with pytest.raises(FileNotFoundError):
        io.must_exist(spark, f"{at}/none", "dataset")
    assert io.first_rows(spark.range(9), 2, "id").count() == 2 and io.first_rows(spark.range(9), None).count() == 9
    df, seen = io.counted(spark.createDataFrame([(1, None), (2, "x")], "n long, s string"), kept="s is not null")
    done = io.write_branches(df, {f"{at}/raw": (None, ["n", "s"]), f"{at}/kept": ("s is not null", ["n"]), f"{at}/impossible": ("n > 5", ["n"])}, skip_empty=(f"{at}/impossible",))
    assert done == [f"{at}/raw", f"{at}/kept"] and seen.get == {"rows": 2, "kept": 1}
    lines = [json.loads(x) for f in sorted((tmp_path / "raw").glob("part*")) for x in f.read_text().splitlines()]
    assert {"n": 1, "s": None} in lines
    io.write_report(df, f"{at}/csv")
    assert next((tmp_path / "csv").glob("part*")).read_text().splitlines()[0] == "n,s"


def test_command_line(spark, capsys):
    from tracewright.__main__ import main

    main(["list"])
    assert "regression_metrics" in capsys.readouterr().out


def test_without_text_operators(tmp_path):
    """The rest imports and lists its queries without the two folders and the pipeline."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parent.parent
    shutil.copytree(root / "tracewright", tmp_path / "tracewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), [q for q in e.queries() if q.startswith('op') or q == 'pipeline'])"], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin"}, capture_output=True, text=True)
    assert out.stdout.strip() == f"{len(catalog.queries())} []", out.stderr
