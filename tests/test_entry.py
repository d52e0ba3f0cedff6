import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A sample of the queries, one from each module; the others are compared by the driver.
SAMPLE = ["fts_documents_topk", "exact_transitions", "lineage_split_merge", "trace_paths", "topic_query_plan", "speech_acts", "context_select"]


def norm(v):
    return str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    r = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in r.description]
    want = sorted(str(tuple(norm(x) for x in row)) for row in r.fetchall())
    assert sorted(cols) == sorted(df.columns)
    assert sorted(str(tuple(norm(x) for x in row)) for row in df.select(*[f"`{c}`" for c in cols]).collect()) == want


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
