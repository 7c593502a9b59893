"""The driver contract, and a few registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract

DATA = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def test_every_query_has_sql_or_a_reason():
    own = {name for name in contract.queries() if name.startswith("q_")}
    assert own <= set(contract.oracle_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")
@pytest.mark.parametrize(
    "name", ["q_all_questions_freq", "q_crosstab_margins", "q_hist_nice", "q_infer_kind", "q_report_lines", "q_delimited_read"]
)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = contract.queries()[name](spark, DATA)
    cur = con.execute(contract.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    expected = sorted(map(repr, cur.fetchall()))
    assert sorted(repr(tuple(r[c] for c in names)) for r in got.collect()) == expected


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")
def test_entry_runs(spark):
    df = contract.entry(spark)
    assert df.columns == ["survey_id", "q_key", "rank", "label", "count", "percentage"] and df.count() > 0
