"""Queries against their SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tracewright import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    show = lambda x: "~" if x is None or x is pd.NA or x != x else f"{float(x):.6f}" if isinstance(x, int | float) and not isinstance(x, bool) else str(x)
    return sorted(tuple(show(x.item() if hasattr(x, "item") else x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, db, name):
    assert rows(catalog.queries()[name](spark, SF).toPandas()) == rows(db.execute(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_truncation_of_odd_texts(spark, tmp_path):
    """Null, empty and blank texts are no exception in the SQL."""
    texts = [None, "", "  ", "\n\t", " " * 1500, "\u3000" * 1200, "a" * 1000, "b" * 1001, "\U0001f600" * 1001]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    odd = duckdb.connect()
    odd.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert rows(catalog.queries()["trace_truncate"](spark, str(tmp_path)).toPandas()) == rows(odd.execute(catalog.oracle_sql()["trace_truncate"]).df())
