"""Runs of long rows: held in parts, and joined without a broadcast although they come from an explode."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cladeloom.functions import aligned as A
from cladeloom.operators import intervals as I
from cladeloom.operators import runs as W


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(spark):
    return spark.createDataFrame([(1, "ACG-TACG", "A-GTT--G"), (2, "", ""), (3, None, None), (4, "AAAA", "A--A")], "g int, ref_text string, row_text string")


def test_runs_of_a_batch_leave_in_parts():
    n = 600_000
    batch = pa.RecordBatch.from_pydict({"g": [1, 2, 3], "a": ["AC" * (n // 2)] * 3, "b": ["A-" * (n // 2)] * 3})
    parts = list(A.gap_run_rows(["g"], "a", "b")(iter([batch])))
    assert sum(p.num_rows for p in parts) == 3 * n // 2 and max(p.num_rows for p in parts) <= n
    assert np.unique(np.concatenate([p.column("ref_len").to_numpy() for p in parts])).tolist() == [n]


def test_runs_of_empty_and_unknown_rows(spark):
    got = W.indel_runs(rows(spark), ["g"], reported_only=False).orderBy("g", "kind", "start").collect()
    assert [tuple(r) for r in got] == [
        (1, 7, "deletion", 2, 2, 1, ""), (1, 7, "deletion", 5, 6, 2, ""), (1, 7, "insertion", 3, 3, 1, "T"), (4, 4, "deletion", 2, 3, 2, "")]


def test_events_meet_their_rows_without_a_broadcast(spark):
    x = rows(spark)
    e = W.indel_runs(x, ["g"]).withColumn("length", F.col("length").cast("bigint"))
    flags = W.event_flags(e, x, ["g"])
    again = W.recheck_runs(e.filter("kind = 'deletion'"), x, ["g"])
    assert plan(flags).count("Exchange hash") == 2  # events and rows are each dealt once
    assert "Broadcast" not in plan(flags) and "Broadcast" not in plan(again)
    assert {(r["g"], r["start"], r["finding"]) for r in again.collect()} == {(1, 2, "exact"), (1, 5, "exact"), (4, 2, "exact")}
    assert not any(r["multi_length"] for r in flags.collect())
    two = flags.sparkSession.createDataFrame([(1, 2, 1), (1, 2, 2), (1, 5, 1)], "g int, start int, length long")
    assert {(r["start"], r["multi_length"]) for r in W.event_flags(two, x, ["g"]).collect()} == {(2, True), (5, False)}


def test_answers_of_an_asof_join_are_not_broadcast(spark):
    a = spark.range(3).select(F.lit(1).alias("k"), F.explode(F.sequence(F.lit(1), F.lit(50))).alias("p"))
    b = spark.createDataFrame([(1, 10), (1, 30)], "k int, q int")
    j = I.asof_join(a, b, ["k"], "p", "q", ["q"], backward=False)
    assert "BroadcastHashJoin LeftOuter" not in plan(j).replace(", ", " ") and "SortMergeJoin" in plan(j)
    assert {(r["p"], r["q"]) for r in j.collect()} == {(p, 10 if p <= 10 else 30 if p <= 30 else None) for p in range(1, 51)}


def test_forward_lookups_read_each_row_once(spark):
    a = spark.range(40).select(F.lit(1).alias("k"), F.col("id").alias("p"))
    b = spark.createDataFrame([(1, 3), (1, 17), (1, 33)], "k int, q int")
    j = I.asof_join(a, b, ["k"], "p", "q", ["q"], backward=False, width=8)
    assert "unboundedfollowing" not in plan(j).lower()
    assert {(r["p"], r["q"]) for r in j.collect()} == {(p, next((q for q in (3, 17, 33) if q >= p), None)) for p in range(40)}
