"""Search-hit evidence on shipments: parts are genes, supplier nations are targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators.intervals import merge_intervals
from .registry import query, table
from .views import HITS, IV, SPECIES, hits, iv, species

RULES = E.HitRules(evalue=0.05, min_qcov=10, min_tcov=12, min_pident=93, min_genera=2,
                   not_counted_taxa=("AFRICA_NATION_0", "EUROPE"), taxon_level="exact", source="ship")

# union coverage of the passing lines on both axes
COVER = """, ax AS (SELECT gene_id, target, 'q' AS axis, qstart AS s, qend AS e FROM good UNION ALL
                    SELECT gene_id, target, 't', sstart, send FROM good),
 am AS (SELECT *, max(e) OVER (PARTITION BY gene_id, target, axis ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM ax),
 ac AS (SELECT gene_id, target, axis, sum(greatest(0, e - greatest(s - 1, coalesce(pe, s - 1)))) AS n FROM am GROUP BY ALL),
 cov AS (SELECT gene_id, target, sum(n) FILTER (axis = 'q') AS qn, sum(n) FILTER (axis = 't') AS tn FROM ac GROUP BY ALL)"""

BEST = """, ranked AS (SELECT *, row_number() OVER (PARTITION BY gene_id, target ORDER BY (evalue > 0.05), evalue, bitscore DESC, line) AS rn FROM hits),
 best AS (SELECT * FROM ranked WHERE rn = 1)"""

EVAL = (
    f"WITH {HITS}, good AS (SELECT * FROM hits WHERE evalue <= 0.05)"
    + COVER
    + BEST
    + """, j AS (SELECT b.*, b.evalue <= 0.05 AS pass, 100.0 * qn / qlen AS qc, 100.0 * tn / slen AS tc
        FROM best b LEFT JOIN cov c ON b.gene_id = c.gene_id AND b.target = c.target),
 w AS (SELECT *, CASE WHEN NOT pass THEN 'E-value above 0.05'
    WHEN qc < 10 THEN 'query coverage ' || round(qc, 1) || '% below 10%'
    WHEN tc < 12 THEN 'target coverage ' || round(tc, 1) || '% below 12%'
    WHEN pident < 93 THEN 'identity ' || round(pident, 1) || '% below 93%'
    WHEN target_species = 'AFRICA_NATION_0' THEN 'own_clade:AFRICA_NATION_0' WHEN split_part(target_species, '_', 1) = 'EUROPE' THEN 'own_clade:EUROPE' END AS why FROM j),
 gen AS (SELECT gene_id, count(DISTINCT split_part(target_species, '_', 1)) AS n FROM w WHERE why IS NULL GROUP BY gene_id),
 ev AS (SELECT w.gene_id, target, target_species, 'ship' AS source, evalue, bitscore, round(qc, 1) AS qcov, round(tc, 1) AS tcov, pident,
   why IS NULL AND n >= 2 AS counts_as_hit,
   CASE WHEN why IS NULL AND n < 2 THEN 'few_genera:' || n ELSE why END AS note,
   coalesce(starts_with(why, 'own_clade:'), false) AS in_phylogeny FROM w LEFT JOIN gen ON w.gene_id = gen.gene_id)"""
)

# parts are the genes; those with p_size > 45 have no proof that their search finished
STATUS = """, genes AS (SELECT 'g' || p_partkey AS gene_id, p_brand AS brand, p_size AS sz FROM part),
 fl AS (SELECT gene_id, count(*) FILTER (counts_as_hit) AS n, bool_or(in_phylogeny) AS own FROM ev GROUP BY gene_id),
 st AS (SELECT g.gene_id, brand, CASE WHEN sz > 45 THEN 'NOT_RUN' WHEN coalesce(n, 0) > 0 THEN 'HIT'
    WHEN own THEN 'IN_PHYLOGENY_ONLY' ELSE 'NO_HIT' END AS status, coalesce(n, 0) AS n_counted_hits
   FROM genes g LEFT JOIN fl ON g.gene_id = fl.gene_id)"""


def parts(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("gene_id"), F.col("p_brand").alias("brand"),
                    F.col("p_size").alias("sz"))


@query("hit_evaluation", EVAL + " SELECT * FROM ev")
def hit_evaluation(spark, sf):
    return E.evaluate_hits(hits(spark, sf), RULES)


@query("gene_status", EVAL + STATUS + " SELECT gene_id, brand, status, n_counted_hits FROM st")
def gene_status(spark, sf):
    p = parts(spark, sf)
    return E.classify_status(p.drop("sz"), E.gene_flags(hit_evaluation(spark, sf)), p.filter("sz <= 45"))


@query(
    "hit_longest_line",
    f"WITH {HITS}{BEST}, l AS (SELECT gene_id, target, max(qend - qstart + 1) AS n FROM hits WHERE evalue <= 0.05 GROUP BY ALL)"
    """ SELECT b.gene_id, b.target, target_species, 'search' AS source, evalue, bitscore, round(100.0 * n / qlen, 1) AS qcov,
    CAST(NULL AS DOUBLE) AS tcov, pident, evalue <= 0.05 AND 100.0 * n / qlen >= 15 AS counts_as_hit,
    CASE WHEN evalue > 0.05 THEN 'E-value above 0.05' WHEN 100.0 * n / qlen < 15 THEN 'query coverage ' || round(100.0 * n / qlen, 1) || '% below 15%' END AS note,
    false AS in_phylogeny FROM best b LEFT JOIN l ON b.gene_id = l.gene_id AND b.target = l.target""",
)
def longest_line(spark, sf):
    return E.evaluate_hits(hits(spark, sf), E.HitRules(evalue=0.05, min_qcov=15, single_line=True, use_tcov=False))


DOMS = HITS + """, doms AS (SELECT gene_id, target, target_species, min(evalue) OVER (PARTITION BY gene_id, target) AS evalue,
   max(bitscore) OVER (PARTITION BY gene_id, target) AS bitscore, round(max(bitscore) OVER (PARTITION BY gene_id, target) * evalue * 4, 2) AS bias,
   evalue AS ievalue, qstart, qend, sstart, send, qlen, slen FROM hits)"""


def doms(spark, sf):
    # the whole-sequence values of a hit repeat on each of its domain lines
    h = hits(spark, sf)
    top = h.groupBy("gene_id", "target").agg(F.min("evalue").alias("ev"), F.max("bitscore").alias("bs"))
    return h.join(top, ["gene_id", "target"]).select(
        "gene_id", "target", "target_species", F.col("ev").alias("evalue"), F.col("bs").alias("bitscore"),
        F.round(F.col("bs") * F.col("evalue") * 4, 2).alias("bias"), F.col("evalue").alias("ievalue"),
        "qstart", "qend", "sstart", "send", "qlen", "slen",
    )


@query(
    "domain_evaluation",
    f"WITH {DOMS}, good AS (SELECT * FROM doms WHERE ievalue <= 0.05 AND evalue <= 0.05)" + COVER
    + """, b AS (SELECT gene_id, target, target_species, evalue, bitscore, min(bias) AS bias, min(qlen) AS qlen, min(slen) AS slen FROM doms GROUP BY ALL),
    j AS (SELECT b.*, 100.0 * coalesce(qn, 0) / qlen AS qc, 100.0 * coalesce(tn, 0) / slen AS tc FROM b LEFT JOIN cov c ON b.gene_id = c.gene_id AND b.target = c.target),
    w AS (SELECT *, CASE WHEN evalue > 0.05 THEN 'E-value above 0.05'
      WHEN bias >= 0.1 * bitscore THEN 'bias' WHEN qc < 10 THEN 'q' WHEN tc < 12 THEN 't' END AS why FROM j)
    SELECT gene_id, target, CASE WHEN evalue <= 0.05 THEN round(qc, 1) END AS qcov, CASE WHEN evalue <= 0.05 THEN round(tc, 1) END AS tcov,
      evalue, bitscore, why IS NULL AS counts_as_hit, why = 'bias' AS biased FROM w""",
)
def domain_evaluation(spark, sf):
    r = E.HitRules(evalue=0.05, min_qcov=10, min_tcov=12, max_bias_frac=0.1)
    return E.evaluate_domains(doms(spark, sf), r).select(
        "gene_id", "target", "qcov", "tcov", "evalue", "bitscore", "counts_as_hit",
        F.col("note").startswith("biased:").alias("biased"),
    )


@query(
    "model_evaluation",
    f"WITH {HITS.replace('n_name AS target', "split_part(species, '_', 1) || lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS target")}"
    ", good AS (SELECT * FROM hits WHERE evalue <= 0.05)" + COVER + BEST
    + """, j AS (SELECT b.*, 100.0 * qn / qlen AS qc, 100.0 * tn / slen AS tc FROM best b LEFT JOIN cov c ON b.gene_id = c.gene_id AND b.target = c.target),
    w AS (SELECT *, coalesce(nullif(regexp_extract(target, '^([A-Za-z]+)[0-9]', 1), ''), 'NA') AS src, CASE WHEN evalue > 0.05 THEN 'E-value above 0.05'
     WHEN round(tc, 1) < 15 THEN 'domain coverage ' || round(tc, 1) || '% below 15%' WHEN round(qc, 1) < 10 THEN 'query coverage ' || round(qc, 1) || '% below 10%'
     WHEN target = 'AFRICA00000' THEN 'ignored:' || target
     WHEN starts_with(target, 'ASIA') THEN 'ignored:ASIA' END AS why FROM j)
    SELECT gene_id, target, src AS source, evalue, bitscore, round(qc, 1) AS qcov, round(tc, 1) AS tcov, pident, why IS NULL AS counts_as_hit,
     why AS note, coalesce(starts_with(why, 'ignored'), false) AS excluded FROM w""",
)
def model_evaluation(spark, sf):
    h = hits(spark, sf)
    number = F.lpad(F.regexp_extract("target", r"(\d+)$", 1), 5, "0")
    h = h.withColumn("target", F.concat(F.element_at(F.split("target_species", "_"), 1), number))
    return E.evaluate_models(h, E.HitRules(evalue=0.05, min_tcov=15, min_qcov=10, ignore_sources=("asia",), ignore_targets=("africa00000",)))


@query(
    "match_evaluation",
    """WITH fam AS (SELECT n_name AS family, bool_or(r_name <> 'AFRICA') AS outside FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1),
    m AS (SELECT o_orderkey AS id, 'g' || o_custkey AS gene_id, split_part(o_orderpriority, '-', 2) AS analysis, n_name AS signature,
      CASE WHEN o_orderstatus = 'P' THEN '?' ELSE 'T' END AS status, o_totalprice AS score FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
    SELECT id, gene_id, m.analysis, m.signature, status, score, CASE WHEN analysis = 'LOW' THEN 'spurious' WHEN analysis = 'MEDIUM' THEN 'excluded' WHEN status <> 'T' THEN 'ignored'
      WHEN signature = 'NATION_7' THEN 'excluded' WHEN analysis = 'URGENT' AND score > 100000 THEN 'ignored'
      WHEN analysis = 'HIGH' AND outside = false THEN 'excluded' ELSE 'counts' END AS class FROM m LEFT JOIN fam ON family = signature""",
)
def match_evaluation(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    fam = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("family"), F.col("r_name").alias("species"))
    m = (
        table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("id"), F.concat(F.lit("g"), F.col("o_custkey").cast("string")).alias("gene_id"),
            F.element_at(F.split("o_orderpriority", "-"), 2).alias("analysis"), F.col("n_name").alias("signature"),
            F.when(F.col("o_orderstatus") == "P", "?").otherwise("T").alias("status"), F.col("o_totalprice").alias("score"),
            F.lit("").alias("ipr"), F.lit("").alias("description"),
        )
    )
    rules = E.MatchRules(
        exclude_analyses=("MEDIUM",), spurious_analyses=("LOW",), evalue_analyses=("URGENT",), ignore_domains=("NATION_7",),
        max_evalue=100000.0, family_analysis="high", family_exclude_species=("AFRICA",),
    )
    return E.evaluate_matches(m, rules, fam).drop("ipr", "description")


# four screens over customers; a missing row means the screen never received the customer
RUNS = ["balance", "segment", "volume", "nation"]
SCREENS = """cnt AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
 cu AS (SELECT 'c' || c_custkey AS gene_id, c_custkey AS k, c_acctbal AS bal, c_mktsegment AS seg, coalesce(n, 0) AS n, c_nationkey AS nat FROM customer LEFT JOIN cnt ON c_custkey = o_custkey),
 w AS (SELECT gene_id, seg, CASE WHEN bal < 0 THEN 'HIT' WHEN bal < 500 THEN 'NOT_RUN' ELSE 'NO_HIT' END AS balance,
   CASE WHEN bal < 0 THEN NULL WHEN seg = 'BUILDING' THEN 'SPURIOUS' WHEN seg = 'MACHINERY' THEN 'HIT' ELSE 'EXCLUDED_ONLY' END AS segment,
   CASE WHEN bal < 500 OR n = 0 THEN NULL WHEN n > 12 THEN 'HIT' ELSE 'NO_HIT' END AS volume,
   CASE WHEN nat < 5 THEN 'IN_PHYLOGENY_ONLY' WHEN nat = 9 THEN 'NOT_RUN' WHEN nat > 20 THEN 'HIT' ELSE 'NO_HIT' END AS nation FROM cu)"""
MATRIX = SCREENS + """, m0 AS (SELECT *, CASE WHEN balance = 'HIT' THEN 'balance;' ELSE '' END || CASE WHEN segment = 'HIT' THEN 'segment;' ELSE '' END ||
   CASE WHEN volume = 'HIT' THEN 'volume;' ELSE '' END || CASE WHEN nation = 'HIT' THEN 'nation;' ELSE '' END AS rb,
   CASE WHEN balance IN ('HIT', 'NOT_RUN') THEN 'balance' WHEN segment IN ('HIT', 'NOT_RUN') THEN 'segment'
        WHEN volume IN ('HIT', 'NOT_RUN') THEN 'volume' WHEN nation IN ('HIT', 'NOT_RUN') THEN 'nation' END AS dropped_by FROM w),
 m AS (SELECT gene_id, seg, CASE WHEN rb <> '' THEN rtrim(rb, ';') END AS removed_by, dropped_by,
   CASE WHEN rb <> '' THEN 'REMOVED' WHEN balance = 'NOT_RUN' OR nation = 'NOT_RUN' OR (volume IS NULL AND balance NOT IN ('HIT', 'NOT_RUN') AND segment NOT IN ('HIT')) THEN 'INCOMPLETE' ELSE 'PASS' END AS verdict,
   CAST(len(string_split(rb, ';')) - 1 AS BIGINT) AS n_runs_removed,
   CAST((balance <> 'NOT_RUN')::INT + (segment IS NOT NULL)::INT + (volume IS NOT NULL)::INT + (nation <> 'NOT_RUN')::INT AS BIGINT) AS n_runs_searched,
   balance, coalesce(segment, 'NOT_SEARCHED') AS segment, coalesce(volume, 'NOT_SEARCHED') AS volume, nation FROM m0)"""


def customers(spark, sf):
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, sf, "customer").join(n, "c_custkey", "left").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("gene_id"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"),
        F.col("c_mktsegment").alias("seg"), F.coalesce("n", F.lit(0)).alias("n"), F.col("c_nationkey").alias("nat"),
    )


def screens(spark, sf):
    """(gene_id, run, status) rows of the four screens."""
    bal, seg, n, nat = F.col("bal"), F.col("seg"), F.col("n"), F.col("nat")
    states = {
        "balance": F.when(bal < 0, E.HIT).when(bal < 500, E.NOT_RUN).otherwise(E.NO_HIT),
        "segment": F.when(bal < 0, None).when(seg == "BUILDING", E.SPURIOUS).when(seg == "MACHINERY", E.HIT).otherwise(E.EXCLUDED_ONLY),
        "volume": F.when((bal < 500) | (n == 0), None).when(n > 12, E.HIT).otherwise(E.NO_HIT),
        "nation": F.when(nat < 5, E.IN_PHYLOGENY_ONLY).when(nat == 9, E.NOT_RUN).when(nat > 20, E.HIT).otherwise(E.NO_HIT),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("run"), s.alias("status")) for r, s in states.items()]))
    return customers(spark, sf).select("gene_id", rows.alias("x")).select("gene_id", "x.*").filter("status is not null")


@query("combine_runs", f"WITH {MATRIX} SELECT * EXCLUDE (seg) FROM m")
def combine_runs(spark, sf):
    return E.combine_runs(screens(spark, sf), RUNS)


@query(
    "unexplained_gaps",
    f"WITH {MATRIX} SELECT gene_id, 'volume' AS run FROM m WHERE volume = 'NOT_SEARCHED' AND coalesce(dropped_by, 'nation') = 'nation'",
)
def gaps(spark, sf):
    return E.unexplained_gaps(screens(spark, sf), RUNS)


def _summary(run: str, pos: int) -> str:
    ok = "IN ('NO_HIT', 'EXCLUDED_ONLY', 'IN_PHYLOGENY_ONLY', 'SPURIOUS')"
    return (
        f"SELECT '{run}' AS run, CAST({pos} AS INTEGER) AS position, count(*) FILTER ({run} <> 'NOT_SEARCHED') AS genes_received, "
        f"count(*) FILTER ({run} = 'HIT') AS removed, count(*) FILTER ({run} {ok}) AS passed, count(*) FILTER ({run} = 'NOT_RUN') AS not_run, "
        f"count(*) FILTER ({run} = 'NOT_SEARCHED') AS not_searched, count(*) FILTER (split_part(removed_by, ';', 1) = '{run}') AS removed_first FROM m"
    )


@query("run_summary", f"WITH {MATRIX} " + " UNION ALL ".join(_summary(r, i + 1) for i, r in enumerate(RUNS)))
def run_summary(spark, sf):
    return E.run_summary(combine_runs(spark, sf), RUNS)


@query(
    "overlap_patterns",
    f"WITH {MATRIX} SELECT replace(removed_by, ';', '+') AS pattern, count(*) AS n_genes FROM m WHERE removed_by IS NOT NULL GROUP BY 1",
)
def overlap_patterns(spark, sf):
    return E.overlap_patterns(combine_runs(spark, sf))


@query(
    "verdict_summary",
    f"""WITH {MATRIX} SELECT coalesce(seg, 'ALL') AS seg, count(*) AS n_genes, count(*) FILTER (verdict = 'PASS') AS "PASS",
    count(*) FILTER (verdict = 'REMOVED') AS "REMOVED", count(*) FILTER (verdict = 'INCOMPLETE') AS "INCOMPLETE" FROM m GROUP BY ROLLUP (seg)""",
)
def verdict_summary(spark, sf):
    m = combine_runs(spark, sf).join(customers(spark, sf).select("gene_id", "seg"), "gene_id")
    return E.verdict_summary(m, "seg")


@query(
    "binary_matrix",
    f"WITH {MATRIX} SELECT gene_id, "
    + ", ".join(f"CAST(CASE WHEN {r} IN ('NOT_RUN', 'NOT_SEARCHED') THEN NULL WHEN {r} = 'HIT' THEN 1 ELSE 0 END AS BIGINT) AS {r}" for r in RUNS)
    + " FROM m",
)
def binary_matrix(spark, sf):
    return E.binary_matrix(combine_runs(spark, sf), RUNS)


@query(
    "chain_screens",
    f"WITH {SCREENS} SELECT gene_id, CAST(CASE WHEN balance <> 'NO_HIT' THEN 1 WHEN segment NOT IN ('SPURIOUS', 'EXCLUDED_ONLY') THEN 2 "
    "WHEN volume IS NULL OR volume = 'HIT' THEN 3 WHEN nation IN ('HIT', 'NOT_RUN') THEN 4 END AS INTEGER) AS stopped_by FROM w",
)
def chain_screens(spark, sf):
    s = screens(spark, sf)
    return E.chain_screens(customers(spark, sf).select("gene_id"), [s.filter(F.col("run") == r) for r in RUNS])


# two databases searched side by side: suppliers of even and of odd nations
@query(
    "pool_runs",
    f"""WITH {HITS}, e AS (SELECT gene_id, target, target_species, CAST(right(target, 1) AS INT) % 2 AS db, evalue <= 0.03 AS c FROM hits),
    d AS (SELECT gene_id, db, target, target_species, bool_or(c) AS c FROM e GROUP BY ALL),
    p AS (SELECT gene_id, count(*) AS n, count(DISTINCT split_part(target_species, '_', 1)) AS genera FROM d WHERE c GROUP BY 1)
    SELECT 'g' || p_partkey AS gene_id, CASE WHEN genera >= 3 THEN 'HIT' WHEN p_size > 45 OR p_size < 3 THEN 'NOT_RUN' ELSE 'NO_HIT' END AS status,
      CASE WHEN genera >= 3 THEN n ELSE 0 END AS n_counted_hits FROM part LEFT JOIN p ON p.gene_id = 'g' || p_partkey""",
)
def pool_runs(spark, sf):
    p = parts(spark, sf)
    h = E.evaluate_hits(hits(spark, sf), E.HitRules(evalue=0.03))
    odd = F.substring("target", -1, 1).cast("int") % 2
    runs = []
    for side, searched in ((0, "sz <= 45"), (1, "sz >= 3")):
        mine = h.filter(odd == side)
        runs.append((mine, E.classify_status(p.select("gene_id"), E.gene_flags(mine), p.filter(searched))))
    return E.pool_runs(runs, p, min_genera=3)


@query(
    "hit_breadth",
    EVAL + " SELECT 'g' || p_partkey AS gene_id, CASE WHEN any_value(p_size) <= 45 THEN count(DISTINCT split_part(target_species, '_', 1) || '_' || split_part(target_species, '_', 2)) END AS n_hit_species, "
    "CASE WHEN any_value(p_size) <= 45 THEN count(DISTINCT split_part(target_species, '_', 1)) END AS n_hit_genera FROM part LEFT JOIN (SELECT * FROM ev WHERE counts_as_hit) e ON e.gene_id = 'g' || p_partkey GROUP BY 1",
)
def hit_breadth(spark, sf):
    p = parts(spark, sf)
    return E.hit_breadth(p.select("gene_id"), hit_evaluation(spark, sf), p.filter("sz <= 45"))


# alignments between customers (candidates) and parts (members) as days of a shipment
ALN = f"""{IV}, al AS (SELECT 'g' || o_custkey AS candidate, 'g' || k AS member, s AS start, e AS "end" FROM iv JOIN orders ON okey = o_orderkey),
 rg AS (SELECT 'g' || k AS member, s AS r_start, e AS r_end FROM iv WHERE flag = 'R' AND k % 3 > 0), nr AS (SELECT DISTINCT 'g' || k AS member FROM iv WHERE k % 3 = 0),
 rc AS (SELECT DISTINCT member, unnest(range(r_start, r_end + 1)) AS p FROM rg), cc AS (SELECT DISTINCT candidate, member, unnest(range(start, "end" + 1)) AS p FROM al)"""


def aln(spark, sf):
    x = iv(spark, sf)
    g = lambda c: F.concat(F.lit("g"), F.col(c).cast("string"))
    a = x.join(table(spark, sf, "orders"), F.col("okey") == F.col("o_orderkey")).select(
        g("o_custkey").alias("candidate"), g("k").alias("member"), F.col("s").alias("start"), F.col("e").alias("end"))
    r = x.filter("flag = 'R' and k % 3 > 0").select(g("k").alias("member"), F.col("s").alias("r_start"), F.col("e").alias("r_end"))
    return a, r, x.filter("k % 3 = 0").select(g("k").alias("member")).distinct()


@query(
    "group_rule",
    f"""WITH {ALN}, ov AS (SELECT candidate, cc.member, count(*) AS n FROM cc JOIN rc ON cc.member = rc.member AND cc.p = rc.p GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY n DESC, member) AS rn FROM ov),
    u AS (SELECT DISTINCT candidate FROM al JOIN nr USING (member))
    SELECT c.candidate, CASE WHEN coalesce(n, 0) >= 20 THEN 'REMOVED_HOG' WHEN u.candidate IS NOT NULL THEN 'REGION_UNKNOWN' ELSE 'PASS' END AS verdict,
      b.member AS best_member, coalesce(n, 0) AS best_overlap
    FROM (SELECT DISTINCT candidate FROM al) c LEFT JOIN b ON b.candidate = c.candidate AND rn = 1 LEFT JOIN u ON u.candidate = c.candidate""",
)
def group_rule(spark, sf):
    a, r, n = aln(spark, sf)
    return E.group_rule(a, r, n)


@query(
    "group_pairs",
    f"""WITH {ALN}, v AS (SELECT 'g' || p_partkey AS gene_id, p_brand AS group_id, CASE WHEN p_size % 3 = 0 THEN 'REMOVED' ELSE 'PASS' END AS verdict FROM part)
    SELECT candidate, al.member, start, "end", c.group_id FROM al JOIN v c ON c.gene_id = candidate AND c.verdict = 'PASS'
    JOIN v m ON m.gene_id = al.member AND m.verdict = 'REMOVED' AND m.group_id = c.group_id WHERE al.member IN (SELECT member FROM rg)""",
)
def group_pairs(spark, sf):
    a, r, _ = aln(spark, sf)
    p = parts(spark, sf).withColumn("verdict", F.when(F.col("sz") % 3 == 0, E.REMOVED).otherwise(E.PASS))
    ev = r.select(F.col("member").alias("gene_id"))
    return E.group_pairs(a, p, p.select("gene_id", F.col("brand").alias("group_id")), ev).select(
        "candidate", "member", "start", "end", "group_id")


@query(
    "group_pair_counts",
    f"""WITH {ALN}, v AS (SELECT 'g' || p_partkey AS gene_id, p_brand AS group_id, p_size % 3 = 0 AS gone FROM part),
    c AS (SELECT group_id, count(*) FILTER (NOT gone) AS n_candidates, count(*) FILTER (gone AND gene_id IN (SELECT member FROM rg)) AS n_members FROM v GROUP BY 1)
    SELECT *, n_candidates * n_members AS n_pairs FROM c WHERE n_candidates > 0 AND n_members > 0""",
)
def group_pair_counts(spark, sf):
    _, r, _ = aln(spark, sf)
    p = parts(spark, sf).withColumn("verdict", F.when(F.col("sz") % 3 == 0, E.REMOVED).otherwise(E.PASS))
    return E.group_pair_counts(p, p.select("gene_id", F.col("brand").alias("group_id")), r.select(F.col("member").alias("gene_id")))


@query(
    "paralog_rule",
    f"""WITH {HITS}, a AS (SELECT gene_id AS query, 'g' || substr(target, 8) AS subject, pident, evalue, round(100.0 * (qend - qstart + 1) / qlen, 2) AS qcov, 100.0 * (qend - qstart + 1) / qlen AS qc FROM hits),
    f AS (SELECT * FROM a WHERE query <> subject AND evalue <= 0.05 AND subject NOT IN (SELECT 'g' || p_partkey FROM part WHERE p_size > 25)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY (pident >= 96 AND qc >= 20) DESC, pident DESC, qc DESC, evalue, subject DESC) AS rn FROM f)
    SELECT query, CASE WHEN pident >= 96 AND qc >= 20 THEN 'REMOVED_PARALOG' ELSE 'PASS' END AS verdict, subject, pident, qcov, evalue FROM r WHERE rn = 1""",
)
def paralog_rule(spark, sf):
    h = hits(spark, sf).select(
        F.col("gene_id").alias("query"), F.concat(F.lit("g"), F.expr("substr(target, 8)")).alias("subject"), "pident", "evalue", "qstart", "qend", "qlen")
    return E.paralog_rule(h, parts(spark, sf).filter("sz > 25"), 0.05, 96.0, 20.0)


@query(
    "two_sided_match",
    f"WITH {HITS}, good AS (SELECT *, qend - qstart + 1 AS len, CAST(floor((qend - qstart + 1) * pident / 100) AS BIGINT) AS ni FROM hits)" + COVER
    + """, g AS (SELECT h.gene_id, h.target, 100.0 * sum(ni) / sum(len) AS ident, greatest(100.0 * any_value(qn) / 220, 100.0 * any_value(tn) / 160) AS cover
      FROM good h JOIN cov c ON h.gene_id = c.gene_id AND h.target = c.target GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY ident * cover DESC, target) AS rn FROM g WHERE ident >= 95 AND cover >= 20)
    SELECT gene_id, target, round(ident, 2) AS ident, round(cover, 2) AS cover FROM r WHERE rn = 1""",
)
def two_sided(spark, sf):
    h = hits(spark, sf).withColumn("length", F.col("qend") - F.col("qstart") + 1)
    h = h.withColumn("n_ident", F.floor(F.col("length") * F.col("pident") / 100))
    return E.two_sided_match(h, 95.0, 20.0)


@query(
    "hit_regions",
    f"WITH {HITS}, good AS (SELECT * FROM hits WHERE evalue <= 0.05), m AS (SELECT *, max(qend) OVER (PARTITION BY gene_id, target ORDER BY qstart, qend ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM good),"
    " i AS (SELECT *, sum(CASE WHEN pe IS NULL OR qstart > pe + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY gene_id, target ORDER BY qstart, qend ROWS UNBOUNDED PRECEDING) AS isl FROM m)"
    " SELECT gene_id, target, min(qstart) AS qstart, max(qend) AS qend FROM i GROUP BY gene_id, target, isl",
)
def hit_regions(spark, sf):
    return merge_intervals(hits(spark, sf).filter("evalue <= 0.05"), ["gene_id", "target"], "qstart", "qend")


@query(
    "passing_sequences",
    f"WITH {MATRIX} SELECT gene_id, c_name AS seq FROM m JOIN customer ON gene_id = 'c' || c_custkey WHERE verdict = 'PASS'",
)
def passing(spark, sf):
    seqs = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("gene_id"), F.col("c_name").alias("seq"))
    return E.passing_sequences(combine_runs(spark, sf), seqs)[0]


@query(
    "run_conflicts",
    f"""WITH {SCREENS}, ok AS (SELECT gene_id FROM w WHERE volume = 'NO_HIT'), listed AS (SELECT gene_id FROM cu WHERE n <= 12 AND bal >= 0)
    SELECT gene_id, 'passed_but_status_fails' AS issue FROM listed WHERE gene_id NOT IN (SELECT gene_id FROM ok)
    UNION ALL SELECT gene_id, 'status_passes_but_not_listed' FROM ok WHERE gene_id NOT IN (SELECT gene_id FROM listed)""",
)
def run_conflicts(spark, sf):
    s = screens(spark, sf).filter("run = 'volume'")
    return E.run_conflicts(s, customers(spark, sf).filter("n <= 12 and bal >= 0"))


@query(
    "taxon_match",
    f"WITH {SPECIES} SELECT s_suppkey, species, regexp_extract(species, '^[^_ ]+') = 'ASIA' OR species = 'AFRICA_NATION_0' AS listed, "
    "lower(regexp_extract(species, '^[^_ ]+')) AS genus, lower(replace(species, ' ', '_')) AS exact_key FROM species",
)
def taxon_match(spark, sf):
    from ..functions.ids import genus_of, taxon_key

    s = species(spark, sf)
    return s.select("s_suppkey", "species", E.matches_taxa(F.col("species"), ["Asia", "Africa Nation-0"], "exact").alias("listed"),
                    genus_of("species").alias("genus"), taxon_key("species", "exact").alias("exact_key"))
