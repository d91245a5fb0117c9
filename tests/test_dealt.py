"""Large inputs are dealt to more tasks the larger they are, small ones are left alone."""

import __spark_entry__ as entry
import cladeloom.common as common
from cladeloom.common import dealt
from cladeloom.plans import sequence_queries as Q


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "PER_TASK", 100)
    parts = lambda n: dealt(spark.range(n).withColumnRenamed("id", "k"), "k").rdd.getNumPartitions()
    assert parts(300) == spark.range(300).rdd.getNumPartitions()
    assert (parts(1000), parts(3000)) == (10, 30)


def test_events_of_a_large_table_are_dealt_by_gene(spark, monkeypatch):
    monkeypatch.setattr(common, "PER_TASK", 500)
    x, _ = Q.events(spark, "/root/testdata/sf0.001")
    assert "REPARTITION_BY_NUM" in x._jdf.queryExecution().executedPlan().toString()


def test_inferred_nodes_work_the_events_out_once(spark):
    plan = entry.queries()["inferred_nodes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # what is left of the customers, who only serve to find the events
    assert "customer.parquet" not in plan


def test_living_support_is_dealt_by_gene(spark, monkeypatch):
    monkeypatch.setattr(common, "PER_TASK", 500)
    sf = "/root/testdata/sf0.001"
    large = entry.queries()["living_support"](spark, sf)
    plan = large._jdf.queryExecution().executedPlan().toString()
    # nodes and species on side branches meet in tasks that grow with the input, which nothing is dealt out of again
    assert "hashpartitioning(gene" in plan[: plan.index("REPARTITION_BY_NUM")] and plan[: plan.index("REPARTITION_BY_NUM")].count("Exchange") == 1
    got = {tuple(r) for r in large.collect()}
    monkeypatch.setattr(common, "PER_TASK", 250_000)
    assert got == {tuple(r) for r in entry.queries()["living_support"](spark, sf).collect()} and got


def test_support_of_odd_rows(spark):
    from cladeloom.operators.classify import evidence
    from cladeloom.operators.tree import tree_tables

    t = tree_tables(spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2), (5, 2), (6, 3), (7, 3)], "node int, parent int"))
    nodes = spark.createDataFrame([("g", 4, 1, "e"), ("g", 4, 2, "e"), ("g", 4, 2, "f"), ("g", 4, 2, "f"), ("h", 4, 1, "e")], "gene string, focal int, ix long, event string")
    car = spark.createDataFrame([("g", "e", 6), ("g", "e", 6), ("g", "f", 7), ("g", "e", 4)], "gene string, event string, species int")
    has = spark.createDataFrame([("g", "e", 5), ("g", "e", 7), ("g", "e", 6), ("g", "f", 6), ("g", None, 6)], "gene string, event string, species int")
    got = {tuple(r) for r in evidence(nodes, car, has, t).select("gene", "focal", "ix", "n_support", "n_against").collect()}
    assert got == {("g", 4, 1, 0, 1), ("g", 4, 2, 3, 3), ("h", 4, 1, 0, 0)}
