"""Quotas of three segments against brute force: short first segments, leftovers for each segment, ties."""

from tracewright import catalog

SF = "/root/testdata/sf0.001"


def quotas(lengths, budget=100):
    got = [min(n, max(8, budget * s // 10)) for n, s in zip(lengths, (4, 4, 2), strict=True)]
    for _ in range(3):
        lack = [n - x for n, x in zip(lengths, got, strict=True)]
        who = lack.index(max(lack))
        got[who] += max(0, min(lack[who], budget - sum(got)))
    return got


def test_three_segments(spark):
    rows = catalog.queries()["three_segment_quotas"](spark, SF).toPandas()
    items = spark.read.parquet(f"{SF}/lineitem.parquet")
    keys = ["l_orderkey", "l_partkey"]
    assert rows[keys].drop_duplicates().shape[0] == items.select(keys).distinct().count()
    gains, ties = [0, 0, 0], 0
    for r in rows.itertuples():
        expect = quotas((r.a, r.b, r.c))
        assert [r.quota_a, r.quota_b, r.quota_c] == expect
        gains = [n + (x > s) for n, x, s in zip(gains, expect, (40, 40, 20), strict=True)]
        ties += r.a - 40 == r.b - 40 > 0 or r.b - 40 == r.c - 20 > 0
    assert min(gains) > 0 and ties > 0 and (rows["a"] < 8).any()
