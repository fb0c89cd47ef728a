"""All queries on the smallest tables: they run, and equal their SQL where they have one."""

import os

import duckdb
import pytest

from tessera.llm import queries

DATA = os.environ.get("TESSERA_TESTDATA", "/root/testdata/sf0.001")
COLUMNS = {
    "p1_found": ["chunk_id", "field", "start_pos", "end_pos"], "p2_found": ["left_id", "right_id"], "p3_found": ["chunk_id"], "p4_found": ["left_id", "right_id"], "p5_found": ["chunk_id", "concept_id"],
    "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    df = queries.QUERIES[name](spark, DATA)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = [tuple(r) for r in df.collect()]
    if name in COLUMNS and name != "p6_ids":
        assert len(rows) == len(set(rows))
    if name in queries.ORACLE:
        con = duckdb.connect()
        for f in os.listdir(DATA):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
        assert sorted(rows) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE[name]})").fetchall())
