"""Plan shape: native paths stay in the JVM, registry joins broadcast, store reads push filters."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["page_links", "resolved_links", "domain_scoped_links", "distinct_urls", "event_listing", "price_display"])
def test_no_python_in_native_paths(spark, name):
    p = plan(E.queries()[name](spark, SF))
    assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p and "MapInPandas" not in p


def test_registry_join_is_broadcast(spark):
    p = plan(E.queries()["messages_with_venue"](spark, SF))
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p


def test_prefix_and_keyset_pushed_to_scan(spark):
    from pyspark.sql import functions as F

    from eventpipe.operators import store as ST

    t = spark.read.parquet(f"{SF}/part.parquet").select(F.col("p_name").alias("pathname"), F.col("p_partkey"))
    p = plan(ST.list_objects(t, prefix="blue", cursor="blue a", limit=5))
    assert "StringStartsWith(p_name,blue)" in p and "GreaterThan(p_name,blue a)" in p
    assert "TakeOrderedAndProject" in p


def test_column_pruning_on_pages(spark):
    p = plan(E.queries()["venue_registry"](spark, SF))
    assert "ReadSchema: struct<url:string>" in p
