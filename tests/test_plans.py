"""What plans must not hold, whatever the tables' size: no table of the input's rows goes to the driver."""

import re

import pytest

from __spark_entry__ import queries
from sheetwise.sources import items

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    """The plan before anything runs, in which sizes are Spark's estimates."""
    return queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["q_frequency_matrix", "q_pages_to_rows", "q_pages_to_sections", "q_pages_to_sentences", "q_read_settings"])
def test_nothing_is_broadcast(spark, name):
    assert "Broadcast" not in plan(spark, name)


@pytest.mark.parametrize("name", ["q_byte_command_table", "q_command_table", "q_command_tables", "q_header_columns"])
def test_tables_move_once(spark, name):
    """Orders and line items are dealt, and their documents; cells, which are many times more, never are."""
    assert plan(spark, name).count("Exchange") <= 3 and "Broadcast" not in plan(spark, name)


def test_orders_are_not_sent_to_their_products(spark):
    """The products of the one document go to the orders; the other way round one task would hold all."""
    assert "BuildRight" in plan(spark, "q_command_specs") and "BuildLeft" not in plan(spark, "q_command_specs")


def test_items_meet_boxes_by_their_places(spark):
    """Rows that are found are dealt by the places of boxes, not by the few squares of a grid; items and boxes may share places."""
    assert re.search(r"Exchange hashpartitioning\([^)]*x0#", plan(spark, "q_box_text_join"))
    found = [(1, 1, 5.0, 5.0, 2.0), (2, 1, 5.0, 5.0, 2.0), (3, 1, 500.0, 5.0, 2.0), (4, 2, 5.0, 5.0, 2.0), (5, 1, None, 5.0, 2.0)]
    drawn = [(7, 1, 0.0, 0.0, 10.0, 10.0), (8, 1, 0.0, 0.0, 10.0, 10.0), (9, 1, 0.0, 0.0, 600.0, 10.0)]
    i = spark.createDataFrame(found, "i int, page int, x double, y double, width double")
    b = spark.createDataFrame(drawn, "b int, page int, x0 double, y0 double, x1 double, y1 double")
    got, plain = (sorted((r.i, r.b) for r in f(i, b, ["page"], 50.0).collect()) for f in (items.crowded_items_in_boxes, items.items_in_boxes))
    assert got == plain == [(1, 7), (1, 8), (1, 9), (2, 7), (2, 8), (2, 9), (3, 9)]
