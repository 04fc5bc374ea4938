import os

import pytest

from crosslattice.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_and_equals_its_sql(spark, name):
    df = QUERIES[name](spark, FOLDER)
    got = df.collect()
    if name in SQL:
        import duckdb

        c = duckdb.connect()
        for t in os.listdir(FOLDER):
            c.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{FOLDER}/{t}'")
        r = c.execute(SQL[name])
        at = [[x[0] for x in r.description].index(k) for k in df.columns]
        assert sorted(map(tuple, got)) == sorted(tuple(x[i] for i in at) for x in r.fetchall())


def test_columns_are_those_asked_for(spark):
    want = {"p1_found": ["pair", "source_id", "candidate_id"], "p3_found": ["align_id", "group_id"], "p4_found": ["node_id_a", "node_id_b"], "p5_found": ["node_id", "group_id"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "kind"]}
    assert {k: QUERIES[k](spark, FOLDER).columns for k in want} == want
