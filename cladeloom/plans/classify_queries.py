"""Classification cascade: orders are genes, discounts are events, ancestors of the customer's nation are the lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import dealt
from ..operators import classify as C
from ..operators import runs as W
from ..session import kept_table
from .registry import query, table
from .sequence_queries import CELL, EV, FOCAL, REF, ROW, STOP, LETTERS, aln, events, frame_stops
from .tree_queries import leaf, lines, nation_tree, parsimony_sql

EVS = EV + """, es AS (SELECT gene, focal, CAST(round(event * 100) AS BIGINT) AS event, CASE WHEN CAST(round(event * 100) AS BIGINT) % 2 = 0 THEN 'indel' ELSE 'stop' END AS kind, list(ix ORDER BY ix DESC) AS ixs FROM ev GROUP BY gene, focal, event HAVING count(*) >= 2),
 orf AS (SELECT o_orderkey AS gene, o_custkey % 4 AS orf_ix FROM orders),
 nr AS (SELECT es.gene, kind, orf_ix, event, ixs, list_min(list_filter(ixs, lambda i: i > orf_ix)) AS near FROM es JOIN orf ON orf.gene = es.gene WHERE NOT list_contains(ixs, orf_ix)),
 ch AS (SELECT *, row_number() OVER (PARTITION BY gene, kind ORDER BY near, len(ixs) DESC, event) AS rn FROM nr WHERE near IS NOT NULL)"""
CHOSEN = EVS + """, cs AS (SELECT orf.gene, orf_ix, (SELECT list_filter(ixs, lambda i: i <= 4) FROM ch WHERE ch.gene = orf.gene AND kind = 'indel' AND rn = 1) AS ii, (SELECT list_filter(ixs, lambda i: i <= 4) FROM ch WHERE ch.gene = orf.gene AND kind = 'stop' AND rn = 1) AS si FROM orf),
 en AS (SELECT *, list_slice(list_sort(list_filter(list_distinct(list_concat(coalesce(ii, []), coalesce(si, []))), lambda i: i > orf_ix)), 1, 2) AS e2 FROM cs),
 gt AS (SELECT gene, orf_ix, CASE WHEN len(e2) = 2 THEN e2[2] || '|' || e2[1] END AS enablers, CASE WHEN len(e2) = 2 THEN e2[1] - orf_ix END AS dist, CASE WHEN len(e2) = 2 AND e2[1] - orf_ix <= 1 THEN 'DNG' ELSE 'PDNG' END AS gene_type, e2 FROM en)"""


def gene_events(spark, sf):
    x, t = events(spark, sf)
    e = W.shared_events(x.select("gene", "focal", "event", "node"), t, contiguous=False)
    n = F.round(F.col("event") * 100).cast("bigint")
    return e.select("gene", "focal", F.when(n % 2 == 0, "indel").otherwise("stop").alias("kind"), n.alias("event"), n.alias("seq"), "ixs")


def orf_nodes(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("gene"), (F.col("o_custkey") % 4).alias("orf_ix"))


@query("nearest_event_choice", f"WITH {EVS} SELECT gene, kind, orf_ix, event, array_to_string(ixs, '|') AS ixs, near FROM ch WHERE rn = 1")
def nearest_event(spark, sf):
    c = C.nearest_event(gene_events(spark, sf), orf_nodes(spark, sf))
    return c.withColumn("ixs", F.array_join(F.col("ixs").cast("array<string>"), "|"))


def types(spark, sf):
    c = C.nearest_event(gene_events(spark, sf), orf_nodes(spark, sf))
    # synteny limit: nothing older than the fourth ancestor
    c = c.withColumn("ixs", C.limit_to_synteny(F.col("ixs"), F.lit(4)))
    w = c.groupBy("gene").agg(F.max_by("ixs", F.when(F.col("kind") == "indel", 1)).alias("indel_ixs"), F.max_by("ixs", F.when(F.col("kind") == "stop", 1)).alias("stop_ixs"))
    return C.gene_types(orf_nodes(spark, sf).join(w, "gene", "left"))


def _show(df):
    return df.select("gene", "orf_ix", F.array_join(F.col("enabler_ixs").cast("array<string>"), "|").alias("enablers"), "dist", "gene_type")


@query("gene_types", f"WITH {CHOSEN} SELECT gene, orf_ix, enablers, dist, gene_type FROM gt")
def gene_types(spark, sf):
    return _show(types(spark, sf))


@query(
    "consecutive_enablers",
    f"WITH {CHOSEN} SELECT gene, CASE WHEN gene_type = 'DNG' AND e2[1] = orf_ix + 1 AND e2[2] = orf_ix + 2 THEN 'DNG' ELSE 'PDNG' END AS gene_type FROM gt",
)
def consecutive(spark, sf):
    return C.require_consecutive(types(spark, sf)).select("gene", "gene_type")


@query(
    "older_orf_rule",
    f"WITH {CHOSEN}, h AS (SELECT l_orderkey AS gene, max(l_linenumber % 4) AS o FROM lineitem WHERE l_quantity > 35 GROUP BY 1) SELECT gt.gene, CASE WHEN gene_type = 'DNG' AND NOT coalesce(o > orf_ix, false) THEN 'DNG' ELSE 'PDNG' END AS gene_type FROM gt LEFT JOIN h ON h.gene = gt.gene",
)
def older_orf(spark, sf):
    h = table(spark, sf, "lineitem").filter("l_quantity > 35").select(F.col("l_orderkey").alias("gene"), (F.col("l_linenumber") % 4).alias("ix"))
    return C.older_orf(types(spark, sf), h).select("gene", "gene_type")


@query(
    "orf_clade_consistency",
    f"""WITH {EVS}, cd AS (SELECT orf.gene, orf.orf_ix AS o0, x AS oi FROM orf, range(0, 4) r(x) WHERE x <= orf.orf_ix),
    n2 AS (SELECT es.gene, kind, oi, event, ixs, list_min(list_filter(ixs, lambda i: i > oi)) AS near FROM es JOIN cd ON cd.gene = es.gene WHERE NOT list_contains(ixs, oi)),
    c2 AS (SELECT *, row_number() OVER (PARTITION BY gene, kind, oi ORDER BY near, len(ixs) DESC, event) AS rn FROM n2 WHERE near IS NOT NULL),
    ins AS (SELECT DISTINCT l_orderkey AS gene, CAST(round(l_discount * 100) AS BIGINT) AS event, CAST(l_linenumber % 4 AS BIGINT) AS ix FROM lineitem WHERE l_quantity > 30),
    bad AS (SELECT DISTINCT c2.gene, oi FROM c2 JOIN ins ON ins.gene = c2.gene AND ins.event = c2.event AND ins.ix = oi WHERE rn = 1 AND oi > 0)
    SELECT cd.gene, max(o0) AS orf_ix, max(oi) AS new_orf_ix, max(oi) <> max(o0) AS moved FROM cd WHERE (gene, oi) NOT IN (SELECT (gene, oi) FROM bad) GROUP BY 1""",
)
def consistency(spark, sf):
    x = table(spark, sf, "lineitem").filter("l_quantity > 30")
    n = F.round(F.col("l_discount") * 100).cast("bigint")
    inside = x.select(F.col("l_orderkey").alias("gene"), F.when(n % 2 == 0, "indel").otherwise("stop").alias("kind"), n.alias("event"), (F.col("l_linenumber") % 4).cast("bigint").alias("ix")).distinct()
    return C.orf_clade_consistency(gene_events(spark, sf), orf_nodes(spark, sf), inside)


# carriers at lineage nodes by the events, on side branches by lines of over 20 pieces; ORF bearers by lines of over 45
INFER = f"""{EVS}, cd AS (SELECT orf.gene, orf.orf_ix AS o0, x AS oi FROM orf, range(0, 4) r(x) WHERE x <= orf.orf_ix),
 n2 AS (SELECT es.gene, kind, oi, event, ixs, list_min(list_filter(ixs, lambda i: i > oi)) AS near FROM es JOIN cd ON cd.gene = es.gene WHERE NOT list_contains(ixs, oi)),
 c2 AS (SELECT *, row_number() OVER (PARTITION BY gene, kind, oi ORDER BY near, len(ixs) DESC, event) AS rn FROM n2 WHERE near IS NOT NULL),
 li AS (SELECT l_orderkey AS gene, CAST(round(l_discount * 100) AS BIGINT) AS event, CAST(l_linenumber % 4 AS BIGINT) AS ix, l_partkey % 2 AS length, l_quantity AS q FROM lineitem),
 bad AS (SELECT DISTINCT c2.gene, oi FROM c2 JOIN li ON li.gene = c2.gene AND li.event = c2.event AND li.ix = oi AND q > 30 WHERE rn = 1 AND oi > 0),
 mv AS (SELECT cd.gene, max(oi) AS oi FROM cd WHERE (gene, oi) NOT IN (SELECT (gene, oi) FROM bad) GROUP BY 1 HAVING max(oi) <> max(o0)),
 c3 AS (SELECT c2.gene, kind, event, c2.oi, ixs, near, list_min(list_filter(ixs, lambda i: i > c2.oi AND (c2.gene + i) % 5 <> 0)) AS own FROM c2 JOIN mv ON mv.gene = c2.gene AND mv.oi = c2.oi WHERE rn = 1),
 fd AS (SELECT DISTINCT c3.gene, kind, c3.event, li.ix FROM c3 JOIN li ON li.gene = c3.gene AND li.event = c3.event WHERE q > 20 AND li.ix > oi AND li.ix < near AND li.length = (c3.event + own) % 2),
 inf AS (SELECT fd.*, CASE WHEN b.gene IS NULL THEN 'added' ELSE 'rejected' END AS status FROM fd LEFT JOIN (SELECT DISTINCT gene, ix FROM li WHERE q > 45) b ON b.gene = fd.gene AND b.ix = fd.ix)"""


def moved_events(spark, sf):
    # events, moved genes and their chosen events are each read by several steps
    x = table(spark, sf, "lineitem")
    ev = dealt(kept_table(gene_events(spark, sf).drop("focal"), "events"), "gene", by=x)
    n = F.round(F.col("l_discount") * 100).cast("bigint")
    kind = F.when(n % 2 == 0, "indel").otherwise("stop").alias("kind")
    side = x.select(F.col("l_orderkey").alias("gene"), kind, n.alias("event"), (F.col("l_linenumber") % 4).cast("bigint").alias("ix"), (F.col("l_partkey") % 2).alias("length"), "l_quantity")
    moved = C.orf_clade_consistency(ev, orf_nodes(spark, sf), side.filter("l_quantity > 30").select("gene", "kind", "event", "ix").distinct()).filter("moved")
    chosen = kept_table(C.nearest_event(ev, moved.select("gene", F.col("new_orf_ix").alias("orf_ix"))), "chosen")
    ix = F.explode("ixs").alias("ix")
    at_node = ev.select("gene", "kind", "event", ix).filter("(gene + ix) % 5 <> 0").withColumn("length", (F.col("event") + F.col("ix")) % 2)
    return chosen, C.inferred_nodes(chosen, at_node, side.filter("l_quantity > 20"), side.filter("l_quantity > 45"))


@query("inferred_nodes", f"WITH {INFER} SELECT * FROM inf")
def inferred(spark, sf):
    return moved_events(spark, sf)[1]


@query(
    "events_with_inferred",
    f"""WITH {INFER}, m AS (SELECT gene, kind, event, list(ix ORDER BY ix) AS more FROM inf WHERE status = 'added' GROUP BY ALL)
    SELECT c3.gene, c3.kind, c3.event, oi AS orf_ix, near, array_to_string(list_concat(ixs, coalesce(more, [])), '|') AS ixs FROM c3 LEFT JOIN m ON m.gene = c3.gene AND m.kind = c3.kind AND m.event = c3.event""",
)
def with_inferred(spark, sf):
    d = C.with_inferred(*moved_events(spark, sf))
    return d.select("gene", "kind", "event", "orf_ix", "near", F.array_join(F.col("ixs").cast("array<string>"), "|").alias("ixs"))


@query(
    "drop_orf_bearing",
    f"""WITH {EVS}, h AS (SELECT l_orderkey AS gene, list(DISTINCT CAST(l_linenumber % 5 AS BIGINT)) AS h FROM lineitem WHERE l_quantity > 30 GROUP BY 1),
    x AS (SELECT es.gene, event, list_filter(ixs, lambda i: NOT list_contains(coalesce(h, []), i)) AS ixs FROM es LEFT JOIN h ON h.gene = es.gene) SELECT gene, event, array_to_string(ixs, '|') AS ixs FROM x WHERE len(ixs) > 0""",
)
def drop_bearing(spark, sf):
    h = table(spark, sf, "lineitem").filter("l_quantity > 30").select(F.col("l_orderkey").alias("gene"), (F.col("l_linenumber") % 5).cast("bigint").alias("ix"))
    d = C.drop_orf_bearing(gene_events(spark, sf), h)
    return d.select("gene", "event", F.array_join(F.col("ixs").cast("array<string>"), "|").alias("ixs"))


@query(
    "drop_orf_bearing_whole",
    f"""WITH {EVS}, h AS (SELECT l_orderkey AS gene, list(DISTINCT CAST(l_linenumber % 5 AS BIGINT)) AS h FROM lineitem WHERE l_quantity > 30 GROUP BY 1) SELECT es.gene, event FROM es LEFT JOIN h ON h.gene = es.gene WHERE NOT list_has_any(ixs, coalesce(h, []))""",
)
def drop_bearing_whole(spark, sf):
    h = table(spark, sf, "lineitem").filter("l_quantity > 30").select(F.col("l_orderkey").alias("gene"), (F.col("l_linenumber") % 5).cast("bigint").alias("ix"))
    return C.drop_orf_bearing(gene_events(spark, sf), h, whole=True).select("gene", "event")


@query("conserved_removed", "SELECT DISTINCT l_orderkey AS gene, l_partkey % 50 AS node FROM lineitem WHERE l_partkey % 50 IN (3, 4) AND l_orderkey IN (SELECT o_orderkey FROM orders)")
def conserved(spark, sf):
    h = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("gene"), (F.col("l_partkey") % 50).alias("node"))
    return C.remove_conserved(orf_nodes(spark, sf), h, [3, 4])[1]


@query(
    "start_gains",
    """SELECT o_orderkey AS gene, o_orderpriority AS taxon, CAST(1 AS INTEGER) AS start, CAST(3 AS INTEGER) AS "end", 'noATG_' || substr('ACGTACG-', CAST(1 + o_custkey % 6 AS BIGINT), 3) AS codon FROM orders
    WHERE o_orderstatus <> 'P' AND strpos(substr('ACGTACG-', CAST(1 + o_custkey % 6 AS BIGINT), 3), '-') = 0 AND o_totalprice <= 200000""",
)
def start_gains(spark, sf):
    o = table(spark, sf, "orders")
    c = F.substring(F.lit("ACGTACG-"), (F.col("o_custkey") % 6 + 1).cast("int"), F.lit(3))
    return C.start_gain_events(o.select(F.col("o_orderkey").alias("gene"), F.col("o_orderpriority").alias("taxon"), c.alias("first_codon"), F.when(F.col("o_orderstatus") == "P", "GTG").otherwise("ATG").alias("ref_first"), (F.col("o_totalprice") > 200000).alias("covered")))


# a first codon of several kinds before the aligned rows
FIRST_REF, FIRST_ROW = "CASE WHEN doc_id % 5 = 0 THEN 'GTG' ELSE 'ATG' END", "CASE doc_id % 6 WHEN 0 THEN 'ATG' WHEN 1 THEN 'A-G' WHEN 2 THEN 'ANG' WHEN 3 THEN 'ACG' ELSE 'CTG' END"
BEFORE = FOCAL.replace(f"translate(t, '{LETTERS}', '{REF}') AS ref", f"{FIRST_REF} || translate(t, '{LETTERS}', '{REF}') AS ref").replace(
    f"translate(t, '{LETTERS}', '{ROW}') AS qry", f"{FIRST_ROW} || translate(t, '{LETTERS}', '{ROW}') AS qry")


def rows_with_start(spark, sf):
    return aln(spark, sf).select(F.col("doc_id").alias("gene"), F.lit("x").alias("taxon"), F.concat(F.expr(FIRST_REF), "ref_text").alias("ref_text"), F.concat(F.expr(FIRST_ROW), "row_text").alias("row_text"))


@query(
    "start_gains_aligned",
    f"""WITH {BEFORE} SELECT aln.doc_id AS gene, 'x' AS taxon, CAST(1 AS INTEGER) AS start, CAST(3 AS INTEGER) AS "end", 'noATG_' || left(qry, 3) AS codon FROM aln LEFT JOIN fr ON fr.doc_id = aln.doc_id AND rn = 1
    WHERE left(ref, 3) = 'ATG' AND aln.doc_id % 6 > 2 AND aln.doc_id % 7 <> 0 AND NOT coalesce(ok, false)""",
)
def start_gains_aligned(spark, sf):
    x = rows_with_start(spark, sf)
    return C.start_gains_from_rows(x, x.filter("gene % 7 = 0"), 3.0, 2.0)


@query(
    "orf_presence_aligned",
    f"""WITH {FOCAL}, kb AS (SELECT doc_id, max(b) AS b FROM own GROUP BY 1), k AS (SELECT aln.doc_id, CASE WHEN ok THEN '1' WHEN coalesce(100.0 * b / n, 0) < 86 THEN 'unknown' ELSE '0' END AS p FROM aln LEFT JOIN fr ON fr.doc_id = aln.doc_id AND rn = 1
      LEFT JOIN kb ON kb.doc_id = aln.doc_id LEFT JOIN nn ON nn.doc_id = aln.doc_id)
    SELECT doc_id AS gene, 'x' AS taxon, p AS presence FROM k UNION ALL SELECT doc_id, 'focal', '1' FROM k UNION ALL SELECT doc_id, 'y', 'unknown' FROM k""",
)
def orf_presence_aligned(spark, sf):
    x = aln(spark, sf).select(F.col("doc_id").alias("gene"), F.lit("x").alias("taxon"), "ref_text", "row_text")
    cells = x.select("gene", F.explode(F.array([F.struct(F.lit(t).alias("taxon"), F.lit(t == "focal").alias("is_focal")) for t in ("x", "y", "focal")])).alias("c")).select("gene", "c.*")
    return C.orf_presence_from_rows(cells, x, 2.0, 0.0, 3.0, 86.0)


@query(
    "indel_event_reasons",
    """WITH e AS (SELECT l_orderkey AS gene, CAST(round(l_discount * 100) AS BIGINT) AS event, bool_or(l_quantity > 40) AS homopolymer, bool_or(l_linenumber = 1 OR l_linenumber = 7) AS t FROM lineitem GROUP BY ALL),
    s AS (SELECT DISTINCT l_orderkey AS gene, CAST(round(l_discount * 100) AS BIGINT) AS event FROM lineitem WHERE l_returnflag = 'R')
    SELECT e.gene, e.event, homopolymer, nullif(concat_ws(',', CASE WHEN t THEN 'terminal_gap' END, CASE WHEN homopolymer AND s.gene IS NULL THEN 'homopolymer_no_extant_support' END), '') AS reason FROM e LEFT JOIN s ON s.gene = e.gene AND s.event = e.event""",
)
def indel_reasons(spark, sf):
    x = table(spark, sf, "lineitem").withColumn("event", F.round(F.col("l_discount") * 100).cast("bigint")).withColumnRenamed("l_orderkey", "gene")
    e = x.groupBy("gene", "event").agg(F.max(F.col("l_quantity") > 40).alias("homopolymer"))
    d = x.select("gene", "event", F.col("l_linenumber").alias("start"), F.col("l_linenumber").alias("end"), F.lit(7).alias("ref_len"))
    return C.filter_indel_events(e, d, x.filter("l_returnflag = 'R'").select("gene", "event"))


@query(
    "inner_stops",
    f"""WITH {CELL}{STOP} SELECT sp.doc_id, CAST(3 * k + 1 AS INTEGER) AS start, CAST(3 * k + 3 AS INTEGER) AS "end", codon, n AS ref_len FROM sp JOIN nn ON nn.doc_id = sp.doc_id WHERE 3 * k + 3 < n""",
)
def inner_stops(spark, sf):
    from .sequence_queries import aln
    from ..functions.seq import ungap

    n = aln(spark, sf).select("doc_id", F.length(ungap("ref_text")).alias("ref_len"))
    return C.filter_stop_events(frame_stops(spark, sf).join(n, "doc_id"))


# living support: suppliers of the same discount carry the event, all suppliers of the order have data
SUP = """, el AS (SELECT DISTINCT gene, focal, unnest(list_filter(ixs, lambda i: i > 0)) AS ix, event FROM es),
 sup AS (SELECT o_orderkey AS gene, CAST(round(l_discount * 100) AS BIGINT) AS event, 32 + c_nationkey AS focal, 32 + s_nationkey AS species, l_returnflag = 'R' AS car FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey),
 sb AS (SELECT *, (SELECT min(k) FROM range(0, 6) r(k) WHERE (focal >> k) = (species >> k)) AS ix FROM sup WHERE focal <> species),
 sc AS (SELECT gene, focal, event, ix, species, bool_or(car) AS car FROM sb GROUP BY ALL), sn AS (SELECT gene, focal, event, ix, count(*) FILTER (car) AS a, count(*) FILTER (NOT car) AS b FROM sc GROUP BY ALL),
 evd AS (SELECT el.gene, el.focal, el.ix, CAST(sum(coalesce(a, 0)) AS BIGINT) AS n_support, CAST(sum(coalesce(b, 0)) AS BIGINT) AS n_against FROM el LEFT JOIN sn ON sn.gene = el.gene AND sn.focal = el.focal AND sn.event = el.event AND sn.ix = el.ix GROUP BY ALL)"""


def support_inputs(spark, sf):
    n = F.round(F.col("l_discount") * 100).cast("bigint")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    x = lines(spark, sf).join(o, "l_orderkey", "left_semi").select(F.col("l_orderkey").alias("gene"), n.alias("event"), leaf("s_nationkey").alias("species"), "l_returnflag")
    el = gene_events(spark, sf).select("gene", "focal", F.explode("ixs").alias("ix"), "event").filter("ix > 0").distinct()
    return el, x.filter("l_returnflag = 'R'").drop("l_returnflag").distinct(), x.drop("l_returnflag").distinct(), nation_tree(spark, sf)


@query("living_support", f"WITH {EVS}{SUP} SELECT * FROM evd")
def living_support(spark, sf):
    return C.evidence(*support_inputs(spark, sf), by=table(spark, sf, "lineitem"))


@query(
    "living_support_outer",
    f"""WITH {EVS}{SUP}, cho AS (SELECT el.gene, el.focal, el.ix, sn.ix AS via FROM el JOIN evd ON evd.gene = el.gene AND evd.focal = el.focal AND evd.ix = el.ix
        JOIN sn ON sn.gene = el.gene AND sn.focal = el.focal AND sn.event = el.event AND sn.ix > el.ix WHERE n_support = 0 AND n_against = 0 AND sn.a > 0 UNION SELECT gene, focal, ix, ix FROM evd WHERE n_support > 0),
      pr AS (SELECT x.gene, x.focal, x.ix AS ai, x.via AS av, y.ix AS bi, y.via AS bv FROM cho x JOIN cho y ON y.gene = x.gene AND y.focal = x.focal AND x.ix < y.ix AND x.via <> y.via
        QUALIFY row_number() OVER (PARTITION BY x.gene, x.focal ORDER BY y.via DESC, x.via DESC, y.ix, x.ix) = 1),
      vi AS (SELECT gene, focal, ai AS ix, av AS via FROM pr UNION ALL SELECT gene, focal, bi, bv FROM pr)
    SELECT evd.*, vi.via FROM evd LEFT JOIN vi ON vi.gene = evd.gene AND vi.focal = evd.focal AND vi.ix = evd.ix""",
)
def living_support_outer(spark, sf):
    return C.evidence(*support_inputs(spark, sf), outer=True, by=table(spark, sf, "lineitem"))


@query(
    "require_extant",
    f"WITH {CHOSEN}{SUP}, ok AS (SELECT gene, bool_and(n_support > 0) AS ok FROM evd GROUP BY 1) SELECT gt.gene, CASE WHEN gene_type = 'DNG' AND coalesce(ok, false) THEN 'DNG' ELSE 'PDNG' END AS gene_type FROM gt LEFT JOIN ok ON ok.gene = gt.gene",
)
def require_extant(spark, sf):
    return C.require_extant(types(spark, sf), living_support(spark, sf)).select("gene", "gene_type")


ALL_TIPS = """SELECT x.unit, 32 + n_nationkey AS node, t.state FROM (SELECT DISTINCT unit FROM tip) x CROSS JOIN nation LEFT JOIN tip t ON t.unit = x.unit AND t.node = 32 + n_nationkey"""


@query(
    "parsimony_filter",
    f"""WITH {CHOSEN}, tip AS (SELECT l_orderkey AS unit, 32 + s_nationkey AS node, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS state FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL), ps AS ({parsimony_sql(ALL_TIPS)})
    SELECT gt.gene, gt.orf_ix, CASE WHEN gene_type = 'DNG' AND coalesce(can0 AND NOT can1, true) THEN 'DNG' ELSE 'PDNG' END AS gene_type FROM gt JOIN orders ON o_orderkey = gt.gene JOIN customer ON c_custkey = o_custkey
      LEFT JOIN ps ON ps.unit = gt.gene AND ps.node = (32 + c_nationkey) >> gt.orf_ix AND gt.orf_ix > 0""",
)
def parsimony_filter(spark, sf):
    t = nation_tree(spark, sf)
    li = table(spark, sf, "lineitem")
    x = lines(spark, sf).select(F.col("l_orderkey").alias("unit"), leaf("s_nationkey").alias("species"), "l_returnflag")
    x = dealt(x, "unit", by=li).groupBy("unit", "species").agg(F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("state"))
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    ty = types(spark, sf).select("gene", "orf_ix", "gene_type")
    f = o.select(F.col("o_orderkey").alias("gene"), leaf("c_nationkey").alias("focal"))
    ch = ty.join(f, "gene").join(F.broadcast(t.lineage.withColumnRenamed("ix", "orf_ix")), ["focal", "orf_ix"]).select(F.col("gene").alias("unit"), "gene", "node")
    return C.parsimony_filter(ty, ch, x, t, by=li)


# a text is a gene with an indel and a stop; ancestors carry them above the ORF node, some species carry them, some are aligned
KNOWN = CELL + """, d AS (SELECT doc_id, 32 + doc_id % 25 AS focal, doc_id % 3 AS orf_ix FROM aln),
 eu AS (SELECT d.*, 2 * doc_id + k AS unit, CASE WHEN k = 0 THEN 1 + doc_id % 30 ELSE 1 + doc_id % 17 END AS p, CASE WHEN k = 0 THEN 3 + 3 * (doc_id % 2) ELSE 3 END AS len FROM d, range(0, 2) r(k)),
 si AS (SELECT unit, count(*) > 0 AS r, bool_and(q NOT IN ('-', 'N')) AS q FROM eu JOIN c ON c.doc_id = eu.doc_id AND c.r <> '-' AND pos BETWEEN p AND p + len - 1 GROUP BY 1),
 tip AS (SELECT unit, node, arg_min(state, k) AS state FROM (SELECT unit, focal AS node, 0 AS state, 0 AS k FROM eu
   UNION ALL SELECT unit, 32 + (doc_id + j) % 25, 1, 1 FROM eu JOIN (VALUES (1, 3), (2, 6), (5, 3), (7, 6)) v(j, l) ON l = len
   UNION ALL SELECT eu.unit, 32 + (doc_id + j) % 25, 0, 2 FROM eu JOIN si ON si.unit = eu.unit CROSS JOIN (VALUES (1), (2), (3), (4), (9)) v(j) WHERE CASE WHEN j % 2 = 0 THEN si.r ELSE si.q END) GROUP BY unit, node)"""


def tips_from_rows(spark, sf):
    a = aln(spark, sf)
    kinds = F.explode(F.array(F.struct(F.lit("indel").alias("kind"), F.lit(0).alias("k")), F.struct(F.lit("stop").alias("kind"), F.lit(1).alias("k")))).alias("e")
    g = F.col("doc_id")
    u = a.select("doc_id", kinds).select(
        (g * 2 + F.col("e.k")).alias("unit"), g.alias("gene"), (F.lit(32) + g % 25).cast("bigint").alias("focal"), "e.kind",
        F.when(F.col("e.k") == 0, 1 + g % 30).otherwise(1 + g % 17).alias("pos"), (g % 3).alias("orf_ix"))
    length = F.when(F.col("kind") == "indel", 3 + 3 * (F.col("gene") % 2)).otherwise(3)
    above = lambda k: F.floor(F.col("focal") / F.pow(F.lit(2), F.col("orf_ix") + k)).cast("bigint")
    sp = lambda j: (32 + (F.col("gene") + j) % 25).cast("bigint")
    has = [(above(1), length), (above(2), F.lit(9)), (sp(1), F.lit(3)), (sp(2), F.lit(6)), (sp(5), F.lit(3)), (sp(7), F.lit(6))]
    car = u.select("gene", "kind", "pos", F.explode(F.array(*[F.struct(t.alias("taxon"), n.cast("bigint").alias("length")) for t, n in has])).alias("c")).select("gene", "kind", "pos", "c.*")
    rows = F.array(*[F.struct(((32 + (F.col("gene") + j) % 25).cast("bigint")).alias("taxon"), F.col("row_text" if j % 2 else "ref_text").alias("row_text")) for j in (1, 2, 3, 4, 9)])
    living = table(spark, sf, "nation").select(leaf("n_nationkey").alias("species"))
    return u, C.tip_states_from_rows(u, car, a.select(g.alias("gene"), "ref_text", "row_text"), living, nation_tree(spark, sf), rows)


@query("tip_states_aligned", f"WITH {KNOWN} SELECT unit, node AS species, state FROM tip")
def tip_states_aligned(spark, sf):
    return tips_from_rows(spark, sf)[1]


@query(
    "parsimony_filter_aligned",
    f"""WITH {KNOWN}, ps AS ({parsimony_sql(ALL_TIPS)}), ok AS (SELECT doc_id, bool_and(can0 AND NOT can1) AS ok FROM eu JOIN ps ON ps.unit = eu.unit AND ps.node = focal >> orf_ix GROUP BY 1)
    SELECT d.doc_id AS gene, CASE WHEN d.doc_id % 4 <> 3 AND ok THEN 'DNG' ELSE 'PDNG' END AS gene_type FROM d JOIN ok ON ok.doc_id = d.doc_id""",
)
def parsimony_filter_aligned(spark, sf):
    u, tips = tips_from_rows(spark, sf)
    ty = u.select("gene", F.when(F.col("gene") % 4 == 3, "PDNG").otherwise("DNG").alias("gene_type")).distinct()
    node = F.floor(F.col("focal") / F.pow(F.lit(2), F.col("orf_ix"))).cast("bigint")
    return C.parsimony_filter(ty, u.select("unit", "gene", node.alias("node")), tips, nation_tree(spark, sf))


PRES = "pc AS (SELECT l_orderkey AS gene, l_linenumber AS taxon, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_returnflag = 'R' THEN '1' WHEN l_quantity * 2 < 50 THEN 'unknown' ELSE '0' END AS presence, l_linestatus AS old FROM lineitem)"


@query("orf_presence", f"WITH {PRES} SELECT old, presence, count(*) AS cells FROM pc GROUP BY ALL")
def orf_presence(spark, sf):
    x = table(spark, sf, "lineitem").select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity").alias("gene"), F.col("l_linenumber").alias("taxon"),
                                            (F.col("l_returnflag") == "R").alias("has_orf"), (F.col("l_quantity") * 2).alias("aligned_pct"), F.col("l_linestatus").alias("old"))
    c = C.orf_presence(x.drop("old"))
    return C.presence_comparison(c, x.select("gene", "taxon", "old"))


@query(
    "gene_status_book",
    "SELECT o_orderkey AS gene, CASE WHEN o_orderstatus = 'P' THEN 'excluded: overlap' WHEN o_totalprice < 20000 THEN 'excluded: duplicate' WHEN o_orderpriority = '5-LOW' THEN 'not counted: gene type' ELSE 'counted' END AS status FROM orders",
)
def status_book(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "gene")
    return C.gene_status(o.select("gene"), [("excluded: overlap", o.filter("o_orderstatus = 'P'")), ("excluded: duplicate", o.filter("o_totalprice < 20000")), ("not counted: gene type", o.filter("o_orderpriority = '5-LOW'"))])
