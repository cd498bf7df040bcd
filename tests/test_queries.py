"""Every query with SQL against that SQL; every query without it runs."""

import importlib.util
import math
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

LLM = importlib.util.find_spec("docloom.llm") is not None


def value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
        return ""
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def rows(pdf):
    return sorted(tuple(map(value, r)) for r in pdf[sorted(pdf.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not re.match(r"p\d", n)))
def test_against_sql(spark, data, name):
    con = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got, want = entry.queries()[name](spark, data).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    fix = lambda pdf: pdf.apply(lambda c: c.astype("Int64") if c.dtype == "float64" and (c.dropna() % 1 == 0).all() else c)
    assert rows(fix(got)) == rows(fix(want))


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in entry.oracle_sql() and not re.match(r"p\d", n)) + ["p5_found"])
def test_runs(spark, data, name):
    assert entry.queries()[name](spark, data).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
