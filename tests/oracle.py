"""Compares a query with SQL that DuckDB runs on the same tables."""

from __future__ import annotations

import decimal

import duckdb

from provenlace.plans.dialect import TABLES


def plain(v):
    return round(float(v), 6) if isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool) else v


def rows_of(df):
    df = df.select(*sorted(df.columns))
    return df.columns, sorted((tuple(map(plain, r)) for r in df.collect()), key=str)


def oracle_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    at = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=str)


def assert_same(df, sql, sf_dir):
    columns, rows = rows_of(df)
    names, want = oracle_rows(sql, sf_dir)
    assert columns == names
    assert len(rows) == len(want)
    assert rows == want
