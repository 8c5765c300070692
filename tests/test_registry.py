import duckdb
import pytest

import __spark_entry__ as registry
from strandwise import catalogue

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Their SQL takes long even on the smallest tables, or the query is timed elsewhere.
SLOW = {"symbol_histogram", "contamination"}


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert len(registry.queries()) == len(set(registry.queries()))


def test_entry(spark):
    assert registry.entry(spark).limit(5).count() == 5


@pytest.mark.parametrize("name", ["gsa_nation_names", "gsa_with_terminators", "plcp_array", "irreducible_prefixes", "interval_tree", "interval_suffix_links", "maximal_repeats", "bwt_transform", "lms_names", "matching_statistics", "next_head_asof", "psv_nsv", "int_sa", "gsa_order_check"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    found, wanted = catalogue.queries()[name](spark, SMALL), con.sql(catalogue.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    key = lambda row: tuple((v is not None, v) for v in row)
    at = [wanted.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in wanted.fetchall()), key=key)
