"""Holds a query's rows against its SQL in DuckDB."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(tuple(_plain(r[c]) for c in names) for r in df.collect())


def sql_rows(sql, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    order = sorted(names)
    return order, sorted(tuple(_plain(r[names.index(c)]) for c in order) for r in got.fetchall())


def same(query, sql, spark, sf_dir):
    assert rows_of(query(spark, sf_dir)) == sql_rows(sql, sf_dir)
