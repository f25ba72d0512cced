import pytest
from compare import rows_of, rows_of_sql

from larkspur.plans import report_queries, search_queries

QUERIES = {**search_queries.QUERIES, **report_queries.QUERIES}
ORACLES = {**search_queries.ORACLES, **report_queries.ORACLES}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, duck, name):
    assert rows_of(QUERIES[name](spark, sf)) == rows_of_sql(duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_registers_everything():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_same_rows_with_other_partitions(spark, sf):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    one = rows_of(QUERIES["full_search"](spark, sf))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert rows_of(QUERIES["full_search"](spark, sf)) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
