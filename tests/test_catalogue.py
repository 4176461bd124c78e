"""Every query of the catalogue that has SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from terrabag.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are missing")


def _rows(df):
    out = []
    for r in df[sorted(df.columns)].itertuples(index=False):
        out.append(tuple("null" if v is None else f"{float(v):.5f}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v) for v in r))
    return sorted(out)


def _frame(names, rows):
    """Rows with nulls as None, so that NaN isn't taken for null."""
    import pandas as pd

    return pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(names)})


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df, cur = catalogue.queries()[name](spark, DATA), con.execute(catalogue.oracle_sql()[name])
    got, want = _frame(df.columns, df.collect()), _frame([c[0] for c in cur.description], cur.fetchall())
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_matched_background_bags(spark, sf):
    """As many bags as sites, of their sizes, each the nearest free cells around one of the random anchors."""
    import hashlib

    d = DATA.replace("sf0.001", sf)
    read = lambda q: duckdb.sql(q).fetchall()
    taken = {divmod(k, 40) for (k,) in read(f"SELECT DISTINCT l_partkey FROM '{d}/lineitem.parquet' WHERE l_quantity >= 49")}
    free = [divmod(k, 40) for (k,) in read(f"SELECT p_partkey FROM '{d}/part.parquet' WHERE p_size % 7 <> 0") if divmod(k, 40) not in taken]
    key = lambda *parts: hashlib.md5(":".join(map(str, (3, *parts))).encode()).hexdigest()
    sites = sorted((key(b), b) for (b,) in read(f"SELECT s_suppkey FROM '{d}/supplier.parquet' WHERE s_suppkey <= 10"))
    want = set()
    for i, ((_, b), (r, c)) in enumerate(zip(sites, sorted(free, key=lambda p: (key(*p), p)), strict=False)):
        near = sorted(free, key=lambda p: ((p[0] - r) ** 2 + (p[1] - c) ** 2, p))[: b % 9 + 3]
        want |= {(f"background-{i:05d}", j + 1, *p) for j, p in enumerate(near)}
    got = [tuple(r) for r in catalogue.queries()["matched_background_bags"](spark, d).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len({r[0] for r in got}) == len(sites)


def test_drop_missing_rows_rounds_as_sql(spark, tmp_path):
    """Values whose seventh digit is a 5, and values too large for a product with a million to be exact."""
    con = duckdb.connect()
    tie = "round((i % 997) / 1e3, 3) + (2 * i + 1) * 5e-7"
    special = "CASE i % 7 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN '-inf'::DOUBLE WHEN 2 THEN NULL WHEN 3 THEN 1e305 ELSE -0.4e-6 END"
    con.execute(f"COPY (SELECT i AS event_id, CASE i % 4 WHEN 0 THEN {tie} WHEN 1 THEN -({tie}) WHEN 2 THEN i * pow(10, i % 60 - 30) / 7 ELSE {special} END AS value FROM range(20000) r(i)) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = [tuple(r) for r in catalogue.queries()["drop_missing_rows"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(con.execute(catalogue.oracle_sql()["drop_missing_rows"]).fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
