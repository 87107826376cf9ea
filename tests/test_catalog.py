import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SOME = ["semantic_multi_metric", "extract_relations", "validate_entities", "graph_entity_id_map",
        "graph_upsert_merge", "history_latest", "usage_cache_hits", "regression_answers"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.queries()) if os.environ.get("CHECK_ALL") else SOME)
def test_query_equals_its_sql(spark, name):
    sql = entry.oracle_sql().get(name)
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got
    if sql is None:
        return
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows_of(names, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 5
