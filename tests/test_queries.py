"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from conforma.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "documents pages conversations lineitem part nation orders supplier customer events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame):
    def cell(x):
        if pd.isna(x):
            return None
        return x if isinstance(x, (str, bool)) else round(float(x), 6)

    df = df[sorted(df.columns)]
    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got, want = Q.queries()[name](spark, SF).toPandas(), duck.execute(Q.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_import_slides_lose_no_text(spark):
    from conforma.sources.adapters import table

    got = Q.queries()["import_slides"](spark, SF).toPandas()
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").select("doc_id", "text").collect()}
    for doc, own in got.groupby("doc_id"):
        lines = [x for c in own.sort_values("slide_no").content for x in c if not x.startswith("[FALTA:")]
        assert all(len(c) <= 6 for c in own.content)
        whole = "".join("".join(lines).split())
        body = "".join(texts[doc].split())
        assert body.endswith(whole) or whole in body or len(body) <= 60


def test_srt_clock_runs_on(spark):
    got = Q.queries()["srt_files"](spark, SF).toPandas()
    for text in got.srt:
        times = [x.split(" --> ") for x in text.split("\n") if " --> " in x]
        assert times[0][0] == "00:00:00,000" and all(a[1] == b[0] for a, b in zip(times, times[1:]))
