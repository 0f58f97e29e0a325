"""Every registered query against its DuckDB oracle on the smallest scale (the driver's gate runs sf0.01)."""

import pytest

import __spark_entry__ as E
from eventpipe.plans import registry
from eventpipe.plans.check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(registry.oracles())
    assert set(registry.queries()) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["topic", "venue", "url", "seq", "body"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_matches_oracle(spark, con, name):
    ok, msg = compare(spark, con, name, E.queries()[name], E.oracle_sql().get(name), SF)
    assert ok, msg


ZONE_SENSITIVE = ["publish_outcome", "date_display", "event_catalogue", "list_objects", "listing_explode",
                  "delivery_schedule", "due_messages", "retry_schedule", "stream_dedup", "event_start_dates"]


@pytest.mark.parametrize("name", ZONE_SENSITIVE)
def test_independent_of_session_time_zone(spark, con, name):
    """The driver's session zone is unknown: results must not move with it (DST gaps included)."""
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        ok, msg = compare(spark, con, name, E.queries()[name], E.oracle_sql().get(name), SF)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert ok, msg
