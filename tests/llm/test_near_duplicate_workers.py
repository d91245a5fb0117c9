"""No stage of the near-duplicate search runs one Python step on the rows of another: every task would hold two Python workers."""

from cladeloom.llm import simhash
from pyspark.sql import functions as F


def test_a_shuffle_parts_the_python_steps(spark, monkeypatch):
    plans, keep = {}, simhash.written

    def watched(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString().splitlines()
        return keep(df, name)

    monkeypatch.setattr(simhash, "written", watched)
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: F.concat(F.lit("w"), (i + (F.col("id") % 4) * 50).cast("string"))))
    docs = spark.range(12).select(F.col("id").alias("doc_id"), F.concat(words, F.lit(" "), F.col("id").cast("string")).alias("text"))
    _, groups = simhash.near_duplicate_groups(docs)
    assert groups.select("root").distinct().count() == 4
    outer = next(i for i, line in enumerate(plans["sets"]) if "MapInArrow" in line)
    inner = next(i for i, line in enumerate(plans["sets"]) if "ArrowEvalPython" in line)
    # the texts are the left side of the join, so what stands between the two lines lies between the two steps
    assert any("- Exchange hashpartitioning" in line for line in plans["sets"][outer:inner]), "\n".join(plans["sets"])
