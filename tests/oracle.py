"""Compares queries with their SQL on DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


def _plain(value):
    return round(value, 9) if isinstance(value, float) else tuple(map(_plain, value)) if isinstance(value, list) else value


def rows(columns, found):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(_plain(r[i]) for i in order) for r in found), key=repr)


def same(spark, db, query, sql, sf_dir):
    df = query(spark, sf_dir)
    result = db.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, result.fetchall())
