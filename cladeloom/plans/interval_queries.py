"""Interval operators on shipments as intervals over days."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ids import format_intervals, parse_intervals
from ..operators import intervals as I
from .registry import query, table
from .views import IV, iv

W = 256

MERGED = """, m AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM iv),
 i AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM m),
 merged AS (SELECT k, min(s) AS s, max(e) AS e FROM i GROUP BY k, isl)"""


@query("merge_intervals", f"WITH {IV}{MERGED} SELECT k, s, e FROM merged")
def merge(spark, sf):
    return I.merge_intervals(iv(spark, sf), ["k"], "s", "e", width=W)


@query(
    "merge_intervals_no_touch",
    f"WITH {IV}{MERGED.replace('pe + 1', 'pe')} SELECT k, s, e FROM merged",
)
def merge_gap0(spark, sf):
    return I.merge_intervals(iv(spark, sf), ["k"], "s", "e", gap=0, width=W)


@query("union_length", f"WITH {IV}{MERGED} SELECT k, CAST(sum(e - s + 1) AS BIGINT) AS covered FROM merged GROUP BY k")
def covered(spark, sf):
    return I.union_length(iv(spark, sf), ["k"], "s", "e", width=W)


CELLS = ", c AS (SELECT DISTINCT k, flag, unnest(range(s, e + 1)) AS p FROM iv)"


@query(
    "overlap_length",
    f"WITH {IV}{CELLS} SELECT k, count(*) FILTER (a AND b) AS overlap FROM (SELECT k, p, bool_or(flag = 'A') AS a, "
    "bool_or(flag <> 'A') AS b FROM c GROUP BY k, p) GROUP BY k",
)
def shared(spark, sf):
    x = iv(spark, sf)
    return I.overlap_length(x.filter("flag = 'A'"), x.filter("flag <> 'A'"), ["k"], "s", "e", width=W)


@query(
    "subtract_intervals",
    f"""WITH {IV}{CELLS}, left_over AS (SELECT k, p FROM c GROUP BY k, p HAVING bool_or(flag = 'A') AND NOT bool_or(flag <> 'A')),
    g AS (SELECT k, p, p - row_number() OVER (PARTITION BY k ORDER BY p) AS isl FROM left_over)
    SELECT k, min(p) AS s, max(p) AS e FROM g GROUP BY k, isl""",
)
def minus(spark, sf):
    x = iv(spark, sf)
    return I.subtract_intervals(x.filter("flag = 'A'"), x.filter("flag <> 'A'"), ["k"], "s", "e", width=W)


@query(
    "interval_text",
    f"WITH {IV}{MERGED}, t AS (SELECT k, string_agg(s || '-' || e, ';' ORDER BY s) AS spans, count(*) AS n FROM merged GROUP BY k) "
    "SELECT k, spans, CAST(n AS INTEGER) AS n FROM t",
)
def interval_text(spark, sf):
    m = I.merge_intervals(iv(spark, sf), ["k"], "s", "e", width=W)
    # merged spans of one part are disjoint, so the list is bounded by the day axis
    arr = F.array_sort(F.collect_list(F.struct(F.col("s").cast("int").alias("a"), F.col("e").cast("int").alias("b"))))
    t = m.groupBy("k").agg(format_intervals(arr).alias("spans"))
    return t.withColumn("n", F.size(parse_intervals("spans")))


@query(
    "overlap_join",
    f"""WITH {IV} SELECT a.k, a.okey AS a_order, a.s AS a_s, a.e AS a_e, b.okey AS b_order, b.s AS b_s, b.e AS b_e
    FROM iv a JOIN iv b ON a.k = b.k AND a.s <= b.e AND b.s <= a.e WHERE a.flag = 'A' AND b.flag <> 'A'""",
)
def overlaps(spark, sf):
    x = iv(spark, sf)
    a = x.filter("flag = 'A'").select("k", F.col("okey").alias("a_order"), F.col("s").alias("a_s"), F.col("e").alias("a_e"))
    b = x.filter("flag <> 'A'").select("k", F.col("okey").alias("b_order"), F.col("s").alias("b_s"), F.col("e").alias("b_e"))
    return I.overlap_join(a, b, ["k"], ("a_s", "a_e"), ("b_s", "b_e"), width=32)


@query(
    "first_overlap_join",
    f"""WITH {IV}, p AS (SELECT a.k, a.okey AS a_order, a.s AS a_s, a.e AS a_e, b.s AS b_s, b.e AS b_e, b.okey AS b_order,
      row_number() OVER (PARTITION BY a.k, a.okey, a.s, a.e ORDER BY b.s, b.e, b.okey) AS rn
      FROM (SELECT DISTINCT k, okey, s, e FROM iv WHERE flag = 'A') a
      LEFT JOIN (SELECT * FROM iv WHERE flag <> 'A') b ON a.k = b.k AND a.s <= b.e AND b.s <= a.e)
    SELECT k, a_order, a_s, a_e, b_s, b_e, b_order FROM p WHERE rn = 1""",
)
def first_overlap(spark, sf):
    x = iv(spark, sf)
    a = x.filter("flag = 'A'").select("k", F.col("okey").alias("a_order"), F.col("s").alias("a_s"), F.col("e").alias("a_e"))
    b = x.filter("flag <> 'A'").select("k", F.col("okey").alias("b_order"), F.col("s").alias("b_s"), F.col("e").alias("b_e"))
    return I.first_overlap_join(a.distinct(), b, ["k"], ("a_s", "a_e"), ("b_s", "b_e"), "b_order", width=W)


@query(
    "nearest_join",
    f"""WITH {IV}, a AS (SELECT DISTINCT k, okey AS a_order, s AS a_s, e AS a_e FROM iv WHERE flag = 'A'),
    b AS (SELECT k, okey AS b_order, s AS b_s, e AS b_e FROM iv WHERE flag <> 'A'),
    l AS (SELECT a.k, a_order, a_s, a_e, 'left' AS side, 0 AS pri, a_s - b_e AS gap, b_s, b_e, b_order FROM a JOIN b ON a.k = b.k AND b_e < a_s),
    r AS (SELECT a.k, a_order, a_s, a_e, 'right' AS side, 1 AS pri, b_s - a_e AS gap, b_s, b_e, b_order FROM a JOIN b ON a.k = b.k AND b_s > a_e),
    u AS (SELECT *, row_number() OVER (PARTITION BY k, a_order, a_s, a_e ORDER BY gap, pri, b_s, b_e, b_order) AS rn
          FROM (SELECT * FROM l UNION ALL SELECT * FROM r) WHERE gap <= 60)
    SELECT a.k, a.a_order, a.a_s, a.a_e, side, gap, b_s, b_e, b_order FROM a LEFT JOIN u
      ON a.k = u.k AND a.a_order = u.a_order AND a.a_s = u.a_s AND a.a_e = u.a_e AND rn = 1""",
)
def nearest(spark, sf):
    x = iv(spark, sf)
    a = x.filter("flag = 'A'").select("k", F.col("okey").alias("a_order"), F.col("s").alias("a_s"), F.col("e").alias("a_e"))
    b = x.filter("flag <> 'A'").select("k", F.col("okey").alias("b_order"), F.col("s").alias("b_s"), F.col("e").alias("b_e"))
    return I.nearest_join(a.distinct(), b, ["k"], ("a_s", "a_e"), ("b_s", "b_e"), ["b_order"], max_gap=60, width=W)


@query(
    "nearest_event",
    """WITH a AS (SELECT event_id, user_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS t FROM events WHERE event_type = 'purchase'),
    b AS (SELECT user_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS t, min(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY 1, 2)
    SELECT event_id, a.user_id, a.t, b.t AS click_t, click_id FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.t >= b.t""",
)
def nearest_event(spark, sf):
    e = table(spark, sf, "events").withColumn("t", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000))
    a = e.filter("event_type = 'purchase'").select("event_id", "user_id", "t")
    b = e.filter("event_type = 'click'").select(
        "user_id", F.col("t").alias("click_t"), F.col("event_id").alias("click_id")
    )
    return I.asof_join(a, b, ["user_id"], "t", "click_t", ["click_t", "click_id"], width=86400)


# exons: distinct shipment starts per part as 3-day exons 5 days apart on a stretched axis; minus strand for odd parts
EXONS = """, ex AS (SELECT DISTINCT k, s * 10 AS x_s, s * 10 + 4 AS x_e, CASE WHEN k % 2 = 1 THEN '-' ELSE '+' END AS strand FROM iv),
 off AS (SELECT *, 5 * (row_number() OVER (PARTITION BY k ORDER BY CASE WHEN strand = '-' THEN -x_s ELSE x_s END) - 1) AS cds_start FROM ex)"""


def exons(spark, sf):
    return (
        iv(spark, sf)
        .select("k", (F.col("s") * 10).alias("x_s"), (F.col("s") * 10 + 4).alias("x_e"))
        .distinct()
        .withColumn("strand", F.when(F.col("k") % 2 == 1, "-").otherwise("+"))
    )


@query(
    "lift_to_cds",
    f"""WITH {IV}{EXONS}, r AS (SELECT DISTINCT k, s * 10 + 2 AS r_s, e * 10 + 3 AS r_e FROM iv),
    j AS (SELECT r.k, r_s, r_e, x_s, x_e, strand, cds_start, greatest(r_s, x_s) AS lo, least(r_e, x_e) AS hi
          FROM r JOIN off ON r.k = off.k AND r_s <= x_e AND x_s <= r_e),
    c AS (SELECT *, cds_start + CASE WHEN strand = '-' THEN x_e - hi ELSE lo - x_s END AS cds_lo FROM j)
    SELECT k, r_s, r_e, x_s, x_e, strand, cds_start, cds_lo, cds_lo + hi - lo AS cds_hi FROM c""",
)
def lift(spark, sf):
    r = iv(spark, sf).select("k", (F.col("s") * 10 + 2).alias("r_s"), (F.col("e") * 10 + 3).alias("r_e"))
    return I.lift_to_cds(r.distinct(), exons(spark, sf), "k", ("r_s", "r_e"), ("x_s", "x_e"), "strand")


@query(
    "lift_to_genome",
    f"""WITH {IV}{EXONS}, r AS (SELECT DISTINCT k, s % 40 AS c_s, s % 40 + 7 AS c_e FROM iv),
    j AS (SELECT r.k, c_s, c_e, x_s, x_e, strand, cds_start, greatest(c_s, cds_start) - cds_start AS lo,
                 least(c_e, cds_start + 4) - cds_start AS hi
          FROM r JOIN off ON r.k = off.k AND c_s <= cds_start + 4 AND cds_start <= c_e)
    SELECT k, c_s, c_e, x_s, x_e, strand, cds_start, CASE WHEN strand = '-' THEN x_e - hi ELSE x_s + lo END AS genome_lo,
           CASE WHEN strand = '-' THEN x_e - lo ELSE x_s + hi END AS genome_hi FROM j""",
)
def unlift(spark, sf):
    r = iv(spark, sf).select("k", (F.col("s") % 40).alias("c_s"), (F.col("s") % 40 + 7).alias("c_e"))
    return I.lift_to_genome(r.distinct(), exons(spark, sf), "k", ("c_s", "c_e"), ("x_s", "x_e"), "strand")


@query(
    "bed_convention",
    f"""WITH {IV}, b AS (SELECT k, sum(e - s) AS z, sum(e - s + 1) AS o FROM iv GROUP BY k),
    q AS (SELECT l_partkey AS k, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY l_partkey)
    SELECT count(*) FILTER (z = n) AS zero_based, count(*) FILTER (o = n) AS one_based,
      CASE WHEN count(*) FILTER (o = n) > count(*) FILTER (z = n) THEN 1 ELSE 0 END AS convention FROM b JOIN q USING (k)""",
)
def convention(spark, sf):
    q = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.sum("l_quantity").cast("bigint").alias("n"))
    return I.detect_bed_convention(iv(spark, sf), q, "k", "s", "e", "n")
