"""Comparison of a Spark result with DuckDB's for the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(d, tables=TABLES):
    con = duckdb.connect()
    for name in tables:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    return con


def _plain(frame):
    frame = frame[sorted(frame.columns)].map(lambda v: None if v is None or v != v else v).astype(str)
    frame = frame.map(lambda v: v[:-2] if v.endswith(".0") else v)
    return sorted(map(tuple, frame.values.tolist()))


def same(df, con, sql):
    ours, theirs = df.toPandas(), con.execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert _plain(ours) == _plain(theirs)
    return len(ours)
