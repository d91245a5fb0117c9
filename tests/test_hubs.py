"""Components of graphs with hubs, without help from adaptive joins."""

import random

from pyspark.sql import functions as F

from cladeloom.operators.graph import connected_components, with_minimum


def components_by_hand(ids, edges):
    at = {i: i for i in ids}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        at[b] = a
    return {i: root(i) for i in ids}


def test_hubs(spark):
    rng = random.Random(1)
    ids = list(range(3000))
    # a star round the largest id, one round the smallest, and chains and pairs that they don't reach
    edges = [(2999, i) for i in range(100, 1100)] + [(i, 0) for i in range(1100, 1700)] + [(i, i + 1) for i in range(1700, 1760)]
    edges += [tuple(rng.sample(range(1800, 2990), 2)) for _ in range(600)] + [(5, 5), (2999, 100)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        e = spark.createDataFrame(edges, "src bigint, dst bigint")
        got = {r.id: r.component for r in connected_components(spark.createDataFrame([(i,) for i in ids], "id bigint"), e).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == components_by_hand(ids, edges)


def test_edges_of_a_hub_are_spread(spark):
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        n = 30000
        u = F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id"))
        low, e = with_minimum(spark.range(n).select(u.alias("u"), (F.col("id") + n).alias("v")))
        per_task = [r["count"] for r in e.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(per_task) == n and max(per_task) < 2.5 * n / 16
        assert e.filter("u = -1").select("m").distinct().collect()[0][0] == n
        assert low.count() == n - n // 3 + 1
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
