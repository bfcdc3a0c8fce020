"""Functions on hand-made rows."""

from pyspark.sql import functions as F

from tracewright.functions import arrays as A
from tracewright.functions import python as P
from tracewright.functions import text as X
from tracewright.operators import scoring as C
from tracewright.operators import segment as G
from tracewright.operators.baseline import fit_line


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_answers(spark):
    s = lambda x: F.lit(x)
    assert one(spark, X.last_boxed(s(r"a \boxed{1} b \boxed{2}")), X.last_boxed(s("none")), X.final_answer(s(r"\boxed{} x"))) == ("2", None, "")
    assert one(spark, X.final_answer(s("Answer: \nlast")), X.final_answer(s("a\n b \n")), X.summary_text(s("x\n<summary> y </summary>"))) == ("last", "b", "y")
    assert one(spark, X.masked(s("x 42 142 = 42"), s("42")), X.masked(s("abc"), s(r"\boxed{}"))) == (f"x {X.MASK} 142 = {X.MASK}", "abc")
    assert one(spark, X.visible_or_all(s("<Think>a</Think> b")), X.visible_or_all(s("<think>a</think>"))) == ("b", "<think>a</think>")
    assert one(spark, F.size(X.ngrams(F.array(s("a")), 2)), A.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == (0, 1.0)


def test_quotas(spark):
    q = A.three_quotas(F.lit(100), F.lit(10), F.lit(5), F.lit(50))
    assert one(spark, q["x0"], q["x1"], q["x2"]) == (35, 10, 5)


def test_text_rules(spark):
    s = lambda x: F.lit(x)
    assert one(spark, X.first_think_or_all(s("a <THINK> x\n</think> b")), X.first_think_or_all(s(" no "))) == ("x", " no ")
    assert one(spark, X.without_think(s("a <Think>x</Think> b")), X.visible_or_all(s("pre < think >a</ think > rest")), X.visible_or_all(s(" pre "))) == ("a  b", "rest", "pre")
    assert one(spark, X.stripped_bodies(s("<think> a </think><THINK>b</THINK>"))) == (["a", "b"],)
    assert one(spark, X.masked(s("y = 7"), s(r"\boxed{7}")), X.masked(s("a ≈ -7"), s("-7")), X.masked(s(r"so \boxed{ 7 }"), s("7")), X.masked(s("x=7a"), s("7"))) == (f"y = {X.MASK}", f"a ≈ {X.MASK}", f"so {X.MASK}", f"x= {X.MASK}a")
    assert one(spark, X.answer_norm(s(r" (\text{cm}1\; 2\,3\left) ")), X.answer_norm(F.lit(None).cast("string")), X.answer_norm(s("()"))) == ("123", "", "")
    assert one(spark, X.final_answer_general(s("<think>q</think>\nFinal answer: 4\n5")), X.final_answer_general(s("a\n答案：6")), X.final_answer_general(s("a\nb "))) == ("4\n5", "6", "b")
    assert one(spark, X.collapsed(s(" a \n b\t")), X.units(s("...")), X.units(s("")), X.units(s("a. b"))) == ("a b", ["..."], [], ["a", "b"])
    assert one(spark, X.equal_chunks(s("abcdef"), 1), X.equal_chunks(s(""), 3), X.equal_chunks(s("   "), 3), X.equal_chunks(s("abcdef"), 3)) == (["abcdef"], [], ["   "], ["ab", "cd", "ef"])
    assert one(spark, X.role(s("assume x is odd")), X.role(s("lets go")), X.role(s("hmm plug   in")), X.role(s("we denote")), X.role(s("a-b"))) == ("plan", "plan", "substitute", "introduce", "derive")
    assert one(spark, A.weights_to_length(F.array(F.lit(1.0), F.lit(3.0)), s(1)), A.weights_to_length(F.array(F.lit(0.0)), s(1)), A.weights_to_length(F.array(F.lit(2.0)), s(0))) == ([1.0], [1.0], [])
    assert one(spark, A.masked_mean(F.array(F.array(F.lit(1.0)), F.array(F.lit(3.0))), F.array(F.lit(0), F.lit(1)))) == ([3.0],)


def test_sentences():
    text = lambda t, v="v1": [x for _, _, x in G.sentences(t, v)]
    assert text("Ok. We add. Then $$a. b$$ holds. End") == ["Ok. We add.", "Then $$a. b$$ holds.", "End"]
    assert text("1. First. Second one", "v2") == ["First. Second one"] or text("1. First. Second one", "v2") == ["First.", "Second one"]
    assert text("") == [] and text(None) == [] and text("- a b c. d e f g.") == ["a b c. d e f g."]
    assert text("$$a$$\nnext line here") == ["$$a$$ next line here"]  # the restored block is short, its placeholder isn't
    assert text("ﬁne words here.") == ["fine words here."] and text("ﬁne words here.", "v3") == ["ﬁne words here."]
    found = G.sentences("Hmmm. One two three. Four five six!\n\n\nSeven eight")
    assert found == [(0, 20, "Hmmm. One two three."), (21, 35, "Four five six!"), (37, 48, "Seven eight")]


def test_macros():
    parts = ["We plan this now.", "x = 1", "y = 2", "Check it.", "a", "b", "c", "d"]
    assert G.spans(parts) == [(0, 1), (1, 3), (3, 7), (7, 8)]
    steps = [G.macro([f"word {i} here"], 0, 1, i, 40) for i in range(40)]
    assert len(G.compressed(steps, 26)) == 26
    walls = [G.macro([f"the answer is {i} here"], 0, 1, i, 40) for i in range(40)]
    assert len(G.compressed(walls, 26)) == 40
    done = G.finished(G.compressed([G.macro([r"so \boxed{4}"], 0, 1, 0, 1)]), r"\boxed{4}")[0]
    assert (done["role"], done["is_conclusion"], done["support_hint"], done["contains_boxed"], done["weak_conclude"]) == ("conclude", True, 1, 1, None)
    assert G.compressed([G.macro(["thus it holds"], 0, 1, 0, 1)])[0]["weak_conclude"] == 1
    assert G.candidates([{"mid": 1, "cheap_score": 0.1}, {"mid": 2, "cheap_score": 0.3}, {"mid": 3, "cheap_score": 0.3}], 2) == [2, 3]


def naive(steps, most):
    """Merging by looking at every pair each time."""
    steps = [G.concluded(x) | {"rel_pos": round(i / len(steps), 3)} for i, x in enumerate(steps, 1)]
    while len(steps) > most:
        costs = [float("inf") if G.wall(a, b) else G.cost(a, b) for a, b in zip(steps, steps[1:], strict=False)]
        if not costs or min(costs) == float("inf"):
            break
        i = costs.index(min(costs))
        steps[i : i + 2] = [G.joined(steps[i], steps[i + 1])]
    return [x["text"] for x in steps]


def test_merging_against_all_pairs():
    import random

    rng = random.Random(2)
    words = ["we plan", "x = 1", "check it", "let y be", "so now", "the answer is", "compute", "because", "thus", "long " * 20]
    for n in (0, 1, 27, 60, 130):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(n)]
        steps = [G.macro(parts, i, i + 1, i, n) for i in range(n)]
        expect = naive(steps, 26)
        if len(expect) <= 26:
            assert [x["text"] for x in G.compressed(steps, 26)] == expect
    plain = [G.macro([rng.choice(words[1:2] + words[6:8] + words[9:]) + f" {i}"], 0, 1, i, 200) for i in range(200)]
    assert [x["text"] for x in G.compressed(plain, 26)] == naive(plain, 26)


def test_budget_and_scorer(spark):
    df = spark.createDataFrame([(1, ["aaaa", "bbb", "cc", "d"]), (2, []), (3, ["aaaaaaaaaa", "b"])], "id long, steps array<string>")
    fitted = C.fit_budget(df, "steps", 5)
    assert [(r.id, r.steps, r.n_head, r.n_tail, r.n_cut) for r in fitted.orderBy("id").collect()] == [(1, ["aaaa", "d"], 1, 1, 2), (2, [], 0, 0, 0), (3, ["b"], 0, 1, 1)]
    assert [r.id for r in C.cut_log(fitted, ["id"]).orderBy("id").collect()] == [1, 3]
    prompts = spark.createDataFrame([(1, "ab"), (2, None)], "id long, prompt string")
    scored = C.score(prompts, "prompt", lambda: lambda ps: [(p.upper(), [float(len(p)), float("nan")]) for p in ps], batch=1)
    assert [(r.output, r.avg_logp) for r in scored.orderBy("id").collect()] == [("AB", 2.0), ("", 0.0)]
    empty = C.score(prompts, "prompt").first()
    assert empty.output == "" and empty.avg_logp != empty.avg_logp
    assert one(spark, C.is_match(F.lit("1"), F.lit("1")), C.is_match(F.lit("1"), F.lit("")), C.is_match(F.lit(None).cast("string"), F.lit("2"), 0)) == (1, None, 0)


def test_line_and_nfkc(spark):
    line = fit_line(spark.createDataFrame([(1.0, 1.0), (3.0, 2.0)], "y double, x double"), "y", "x")
    assert (line.slope, line.intercept) == (2.0, -1.0)
    flat, none = spark.createDataFrame([(4.0, 1.0)], "y double, x double"), spark.createDataFrame([], "y double, x double")
    assert fit_line(flat, "y", "x").intercept == 4.0 and fit_line(none, "y", "x").intercept == 0.0
    assert one(spark, P.nfkc(F.lit("\ufb01\u2460")), P.nfkc(F.lit(None).cast("string"))) == ("fi1", None)


def test_marks_against_patterns():
    """Looking words up tells the same as trying the pattern of each role."""
    import random
    import re

    from tracewright.functions import text as T

    find = lambda pattern, t: re.search(pattern, t) is not None
    rng = random.Random(5)
    bits = "Plan let 's we will shall plug in  substitute back FINAL answer is answer: conclusion thus check ſet f\u0130rst \u212ab che\u212a = - \\frac \\pi ≥ \\boxed{1} _ . é plan_x x".split(" ")
    for _ in range(3000):
        t = rng.choice((" ", "")).join(rng.choice(bits) for _ in range(rng.randint(1, 8)))
        eq, dense, names, final = G.marks(t)
        assert (eq, dense) == (find(T.EQUATION, t), find(T.EQUATION, t) or find(T.SYMBOLIC, t))
        assert {n for n in T.ROLES if n != "derive" and find(T.ROLES[n], t)} == set(names)
        low = t.lower()
        assert final == ("\\boxed" in t or "final answer" in low or "answer is" in low)
        latex = "".join(rng.choice(("$$", "$", "\\(", "\\)", "\\[", "\\]", "a", "\n")) for _ in range(rng.randint(0, 9)))
        assert G.held_blocks(latex)[1] == re.findall(T.LATEX_BLOCK, latex)


def test_steps_mark_each_sentence_once(spark, monkeypatch):
    """Single sentences that are steps are not searched again, a merge doesn't search the joined text, and rows come back flat, without the trace."""
    calls, real = [], G.marks
    monkeypatch.setattr(G, "marks", lambda t: calls.append(t) or real(t))
    parts = [f"word {i} here" for i in range(500)]
    steps = G.compressed(G.steps_of(parts), 26)
    assert calls == parts and len(steps) == 26 and " ".join(x["text"] for x in steps) == " ".join(parts)
    monkeypatch.undo()
    df = spark.createDataFrame([(7, "We plan this now. So x = 1. Thus the answer is 4.", "4"), (8, None, None), (9, "", "")], "k long, t string, g string")
    rows = G.macro_rows(df, "k", "t", most=26, gold="g", top=1)
    assert rows.columns[:4] == ["k", "candidate_macro_ids", "mid", "start_sid"] and "Generate" not in rows._jdf.queryExecution().executedPlan().toString()
    nested = G.with_steps(df, "t", "g", 26, 1).select("k", "candidate_macro_ids", F.inline("macro_steps"))
    assert sorted(map(str, rows.collect())) == sorted(map(str, nested.collect())) and rows.count() == 3 and nested.schema == rows.schema


def test_joined_step_knows_its_text():
    """What merging asks of a joined step's text, kept without the text, is what the text would tell."""
    for a, b in (("so it is final", "answer here"), ("the answer", "is 4"), ("combine", "like terms now"), ("so", "now"), ("thus", "x"), ("a", "b"), ("word " * 20, "combine"), ("\\boxed{1}", "c")):
        whole = G.concluded(G.macro([f"{a.strip()} {b}"], 0, 1, 0, 1))
        got = G.joined(*(G.concluded(G.macro([x], 0, 1, 0, 1)) for x in (a, b)))
        assert all(got[k] == whole[k] for k in ("text", "size", "lead", "tail", "continues", "final", "tokens"))


def test_unmerged_steps_send_no_trace_back(spark):
    rows = G.macro_rows(spark.createDataFrame([(1, "One two three. Four = 5.")], "k long, t string"), "k", "t")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "sentences" not in plan and [(r.mid, r.text) for r in rows.collect()] == [(1, "One two three."), (2, "Four = 5.")]
