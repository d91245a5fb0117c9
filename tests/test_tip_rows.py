"""Rows of several taxa that follow from one text: the text meets the sites of its gene once."""

import __spark_entry__ as entry


def test_copies_of_a_text_do_not_travel(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()["tip_states_aligned"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    texts = [below for i, line in enumerate(plan) if "Exchange hashpartitioning(gene#" in line and "ref_text#" in (below := " ".join(plan[i + 1 : i + 4]))]
    assert texts and not any("Generate" in x for x in texts)
