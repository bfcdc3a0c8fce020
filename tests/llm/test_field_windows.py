"""The field's decoding against all segmentations, and stretch by stretch against the whole text."""

import random

import pytest

from tracewright.llm import op5_pii


@pytest.fixture(scope="module")
def weights():
    return op5_pii.fit()


def segmentations(spans, i, n):
    if i == n:
        yield []
        return
    yield from segmentations(spans, i + 1, n)
    for a, b in spans:
        if a == i:
            for k in range(4):
                for rest in segmentations(spans, b, n):
                    yield [(a, b, k), *rest]


def total(tokens, chosen, weights):
    after, score, at, label = op5_pii._after(weights), 0.0, 0, op5_pii.OUT
    for a, b, k in [*chosen, (len(tokens), None, op5_pii.OUT)]:
        if a > at:
            score, label = score + after[label][op5_pii.OUT], op5_pii.OUT
        score += after[label][k]
        if b:
            score += op5_pii._score(weights, op5_pii.features(tokens, a, b), 4)[k]
            at, label = b, k
    return score


def test_best_of_all_segmentations(weights):
    rng = random.Random(4)
    for text in ("ring 555-1234 or", "a at b dot de 1234", "10.0.0.1 12345", "+49 30 1234", "x@y.de,z"):
        for w in (weights, {f: [rng.gauss(0, 2) for _ in range(4)] for f in [*weights, *(f">{y}" for y in range(5)), ">out"]}):
            tokens = op5_pii._TOKEN.findall(text)
            best = max(total(tokens, c, w) for c in segmentations(op5_pii.admissible(tokens), 0, len(tokens)))
            assert total(tokens, op5_pii.decode(tokens, w), w) == pytest.approx(best)


def test_stretches(weights):
    for span in ("jane (AT) example.com", "jane[AT]example[DOT]com"):
        text = f"write to {span} today"
        assert [text[a:b] for _, a, b in op5_pii.field_spans(text, weights)] == [span]
    rng = random.Random(3)
    parts = ["jane AT example DOT com", "jane[AT]example[DOT]com", "jane (At) example.com", "a@b.org", "555_123_4567", "+1\u00a0555\u00a0123\u00a04567", "555\u2013123\u20134567", "1,234,567", "1234", "1 2 3 4", "v1.2", "at", "look at me. dot"]
    for _ in range(60):
        text = " ".join(rng.choice(parts) if rng.random() < 0.2 else "word" for _ in range(60))
        tokens = op5_pii._TOKEN.findall(text)
        at = [0]
        for t in tokens:
            at.append(at[-1] + len(t))
        assert op5_pii.field_spans(text, weights) == [(k, at[i], at[j]) for i, j, k in op5_pii.decode(tokens, weights)]


def test_accuracy_on_other_sentences(weights):
    """Sentences that the generator writes from another seed."""
    rng, hit, found, gold_n = random.Random(99), 0, 0, 0
    for _ in range(400):
        tokens, gold = op5_pii._sentence(rng)
        got = set(op5_pii.decode(tokens, weights))
        hit, found, gold_n = hit + len(got & gold), found + len(got), gold_n + len(gold)
    assert hit / found > 0.93 and hit / gold_n > 0.93, (hit, found, gold_n)


def test_table(spark):
    rows = [(1, None, "x", 1), (2, "", "x", 1), (None, "a@b.de", "x", 1), (4, "card 4111 1111 1111 1111", "x", 1), (4, "card 4111 1111 1111 1111", "x", 1), (5, "w " * 50000 + "+1 (555) 123-4567", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string, n_ip long")
    got = op5_pii.personal_data(docs).toPandas()
    assert len(got) == 6 and got["n_email"].sum() == 1 and got["n_card"].sum() == 2 and got["n_phone"].sum() == 1
    assert op5_pii.personal_data(docs.limit(0)).count() == 0
