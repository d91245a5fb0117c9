"""Every step that gene, event or unit decides goes to a number of tasks that grows with the input; the tree's own tables are broadcast."""

import re

import __spark_entry__ as entry
import cladeloom.common as common
import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["shared_events_gap_filled", "parsimony_filter"])
def test_steps_are_dealt(spark, monkeypatch, name):
    monkeypatch.setattr(common, "PER_TASK", 500)
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # exchanges by gene, event or unit that leave the number of tasks to Spark
    loose = [x for x in re.findall(r"Exchange hashpartitioning\((.*?), 4\), ENSURE_REQUIREMENTS", plan) if re.search(r"gene#|unit#|event#", x)]
    assert "REPARTITION_BY_NUM" in plan and not loose, loose


def test_dealt_gaps_are_the_same(spark, monkeypatch):
    own = lambda: {tuple(r) for r in entry.queries()["shared_events_gap_filled"](spark, SF).collect()}
    small = own()
    monkeypatch.setattr(common, "PER_TASK", 500)
    assert own() == small and small
