"""What reading generated logs costs: lines made once, one sort per file, columns only for readers."""

import json

from pyspark.sql import functions as F

from meterlake.operators import ordered
from meterlake.plans import catalog
from meterlake.sources import producers

from .conftest import DATA


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_made_once_and_unread_columns_not_at_all(spark):
    for lines, parse in ((catalog._transcript_lines, producers.parse_a), (catalog._span_lines, producers.parse_c)):
        plan = optimized(parse(lines(spark, DATA)).usage.select("session_id", "dedup_key", "input_fresh"))
        assert "to_json" not in plan and "format_string" not in plan
        assert not [x for x in plan.splitlines() if "Filter" in x and "concat" in x]  # a filter reads a line, it does not make one


def test_steps_of_a_file_take_one_sort(spark):
    rows = spark.createDataFrame([("f", 1, 5, 5, 5, 5)], "f string, i long, inp long, cumulative long, last_inp long, last_total long")
    plan = ordered.reconcile(rows, "f", ["i"], ["inp"], "cumulative", "last")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1


def test_last_attribute_that_has_a_value(spark):
    def attribute(key, value):
        return {"key": f"gen_ai.usage.{key}_tokens", "value": value if value is None else {"intValue": value}}

    def span(*attributes):
        return json.dumps({"name": "chat", "spanId": "x", "attributes": [attribute(*a) for a in attributes]})

    cases = [span(("input", 5), ("input", 7), ("output", 1)), span(("input", 5), ("input", None), ("output", 2)), span(("input", None), ("output", 3))]
    lines = spark.createDataFrame([("f", i, v) for i, v in enumerate(cases)], "file_id string, ordinal long, value string")
    got = producers.parse_c(lines).usage.orderBy("ordinal").select("input_fresh", "output_total").collect()
    assert [tuple(r) for r in got] == [(7, 1), (5, 2), (0, 3)]


def test_texts_as_format_string_has_them(spark):
    rows = spark.createDataFrame([(1, "a"), (None, None)], "n long, s string")
    template = '{"n":%d,"s":"%s"}'
    assert rows.filter(~catalog.text(template, F.col("n"), F.col("s")).eqNullSafe(F.format_string(template, "n", "s"))).count() == 0
