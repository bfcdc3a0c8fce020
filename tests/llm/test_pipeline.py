"""The pipeline as a whole against brute force on a small table, and its stages on odd ones."""

import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import op4_quality_rules, op6_pack, op8_secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, position long, __id string"


def rows():
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    found = [text(rng.randint(60, 200)) for _ in range(60)]
    for t in found[:15]:  # near copies on both sides of the threshold
        w = t.split()
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        found.append(" ".join(w))
    found += found[:4]
    found += [text(80) + " password: hunter22 " + text(10), text(30), "one two " * 80, None, "", text(9000)]
    rng.shuffle(found)
    out = [(i, t, "en", None if i % 9 == 0 else f"s{i % 7 % 3}", None if t is None else len(t), "k", 5, "z") for i, t in enumerate(found)]
    return [*out, out[3], (None, text(70), None, "s1", 1, None, None, None)]


def kept_by_hand(table):
    good = []
    for r in table:
        m = dict(zip(op4_quality_rules.NAMES, op4_quality_rules.measure(r[1]), strict=True))
        w = (r[1] or "").split()
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
        if len(w) >= 50 and 100 * len(cover) <= 50 * len(w) and not any(eval(rule, {}, m) for _, rule in op4_quality_rules.RULES):  # noqa: S307
            good.append(r)
    sets = []
    for r in good:
        w = r[1].split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    group = list(range(len(good)))
    for i in range(len(good)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for g, r in zip(group, good, strict=True):
        at = 1 << 60 if r[0] is None else r[0]
        if g not in least or at < least[g][0]:
            least[g] = (at, r)
    return [r for _, r in least.values()]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{at}/documents.parquet")
    return at


def test_run(spark, sf_dir):
    expect = {r[0]: r for r in kept_by_hand(rows())}
    assert 40 < len(expect) < 75 and None in expect
    encoder = op6_pack.Encoder()
    ids = {i: len(encoder.ids([op8_secrets.redact_text(r[1], op8_secrets.scan_text(r[1])[1])])[0]) // 2 for i, r in expect.items()}
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    names = [None if x != x else int(x) for x in got["doc_id"]]
    total = Counter()
    for i, n in zip(names, got["length"], strict=True):
        total[i] += n
    assert dict(total) == ids
    at = (got["sequence_id"] * 4096 + got["offset"]).to_numpy()
    order = np.argsort(at)
    assert at[order][0] == 0 and (at[order][1:] == (at + got["length"].to_numpy())[order][:-1]).all()


def test_mixing_takes_effect(spark, sf_dir, monkeypatch):
    """With small windows, every stretch of the packed stream has the sources in the proportions of the mix, which blocks of 64 rows don't show here."""
    from tracewright.llm import op10_mix

    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("text of "), "id").alias("text"), F.when(F.col("id") < 500, "big").otherwise("small").alias("source"))
    mixed = op10_mix.interleaved(docs, {"big": 0.75, "small": 0.25}, block=1)
    path = f"{sf_dir}/mixed"
    mixed.write.parquet(path)
    got = op6_pack.pack_mixed(spark.read.parquet(path), window=16).where("start = 0").orderBy("sequence_id", "offset").toPandas()
    small = [i >= 500 for i in got["doc_id"]]
    assert len(small) == 600 and all(2 <= sum(small[k : k + 16]) <= 6 for k in range(0, 384, 16)) and sum(small[:400]) == 100


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, sf_dir, name):
    """Columns stay; an empty table gives none; a stage works on its own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, sf_dir)
    if name != "packing":
        assert out.dtypes == docs.dtypes
        n = {"quality": None, "near_dedup": None}.get(name, docs.count())
        assert n is None or out.count() == n
    else:
        assert out.agg(F.countDistinct("doc_id")).first()[0] == docs.where("doc_id is not null").select("doc_id").distinct().count()
    empty = spark.createDataFrame([], docs.schema)
    assert stage(spark, empty, sf_dir).count() == 0
