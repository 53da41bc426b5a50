"""Frames of the queries: a table that grows with the rows is not sent through the driver."""

from workload import fixtures as X


def test_labelled_orders_are_joined_without_a_broadcast(spark, sf):
    rows = X.labelled(spark, sf)
    assert rows.count() == X.table(spark, sf, "orders").count()
    assert "BroadcastHashJoin" not in rows._jdf.queryExecution().toString()
