"""A registered query next to its check SQL over the same tables."""

import duckdb

TABLES = ("documents", "benchmark", "pages", "labels", "conversations", "embeddings")


def compare(spark, sf, queries, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got = queries.queries[name](spark, sf)
    want = con.execute(queries.sql[name])
    names = [d[0] for d in want.description]
    rows = {tuple(r) for r in want.fetchall()}
    mine = [tuple(r) for r in got.select(*names).collect()]
    assert set(mine) == rows and len(mine) == len(rows) > 0
