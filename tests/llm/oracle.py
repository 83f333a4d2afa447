"""Runs a query's SQL in DuckDB over the same Parquet files or over a small table."""

import duckdb


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def sql_rows(sql, tables):
    """tables: name to a path or a Spark DataFrame."""
    c = duckdb.connect()
    for name, t in tables.items():
        if isinstance(t, str):
            c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{t}'")
        else:
            arrow = t.toArrow()
            c.register(name, arrow)
    got = c.sql(sql)
    order = sorted(range(len(got.columns)), key=lambda i: got.columns[i])
    return sorted((tuple(r[i] for i in order) for r in got.fetchall()), key=str)
