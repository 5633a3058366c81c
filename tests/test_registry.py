"""Registered queries against their SQL twins on the smallest data set."""

import os

import pytest

import __spark_entry__ as contract
from structaudit.plans import registry

SF = "/root/testdata/sf0.001"
CHECKED = [
    "name_first_findings", "reference_matches", "policy_outcomes", "scorecard", "candidate_budget", "page_references",
    "source_cascade", "alias_lookup", "fuzzy_labels", "service_verdicts", "page_figures", "stored_replay",
    "deck_check_findings", "deck_check_summary", "loose_lookup", "resolved_salts", "drawing_regions", "did_you_mean", "phrase_scores",
]


def test_contract_names():
    queries, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(queries) and set(registry.QUERIES) <= set(queries)
    assert set(registry.QUERIES) == set(registry.SQL)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not mounted")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    import duckdb

    from tools.check_oracle import TABLES, bag

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = contract.queries()[name](spark, SF)
    cur = con.execute(contract.oracle_sql()[name])
    assert bag(df.columns, df.collect()) == bag([c[0] for c in cur.description], cur.fetchall())


def test_entry(spark):
    assert contract.entry(spark).columns == ["truth", "verdict", "grade", "n"]
