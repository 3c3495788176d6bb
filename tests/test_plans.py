"""Physical plans: no all-pairs joins, no row-wise Python, filters and columns reach the scan."""

import pytest

from conftest import SF

from brierworks.plans.catalog import QUERIES

# state handlers of streams run in Python workers and are not part of these plans
SKIP = ("ml0", "st0")
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(SKIP)))
def test_no_costly_operator(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert not [f for f in FORBIDDEN if f in text]


def test_pushdown_and_pruning(spark):
    text = plan(QUERIES["src01_read_table"](spark, SF))
    assert "PushedFilters: [IsNotNull(event_type), IsNotNull(value), EqualTo(event_type,view), GreaterThan(value,50.0)]" in text
    assert "ReadSchema: struct<event_id:bigint,event_type:string,value:double>" in text


def test_dashboard_reads_three_scans_of_needed_columns(spark):
    text = plan(QUERIES["agg01_dashboard"](spark, SF))
    assert "props" not in text


def test_dashboard_copies_no_row_before_its_shuffles(spark):
    text = plan(QUERIES["agg01_dashboard"](spark, SF))
    assert text.count("Generate explode") == 1
    assert text.index("Generate explode") < text.index("ObjectHashAggregate") < text.index("Exchange")


def test_market_tickers_are_split_once_a_market(spark):
    text = plan(QUERIES["src14_decode_markets"](spark, SF))
    tree = text[text.index("Initial Plan"):] if "Initial Plan" in text else text
    assert tree.count("split(m#") == 1


def test_orders_are_dealt_out_before_their_listings_are_written(spark):
    from brierworks.plans.source_queries import landed_listings

    landed = landed_listings(spark, SF)
    assert len(landed.inputFiles()) > spark.sparkContext.defaultParallelism
    assert landed.count() == spark.read.parquet(f"{SF}/orders.parquet").count()
