"""Runs a query's SQL in DuckDB over the same Parquet files."""

from pathlib import Path

import duckdb


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def sql_rows(sql, sf_dir):
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = c.sql(sql)
    order = sorted(range(len(got.columns)), key=lambda i: got.columns[i])
    return sorted((tuple(r[i] for i in order) for r in got.fetchall()), key=str)
