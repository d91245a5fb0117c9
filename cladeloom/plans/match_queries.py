"""Records matched to proteins: orders are transcripts, their lines exons, and every order has two records in one of ten styles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import record_match as R
from .registry import query, table

PR = """od AS (SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderkey % 10 IN (5, 6) AND o_orderkey % 3 > 0 THEN 'u' || o_orderkey ELSE 'c' || o_custkey END AS g,
   CASE WHEN o_orderkey % 10 IN (5, 6) AND o_orderkey % 3 > 0 THEN o_orderkey ELSE o_custkey + 1000000000000 END AS gn,
   CASE o_orderkey % 10 WHEN 8 THEN 'p' || o_orderkey || '.p' WHEN 9 THEN 'P' || o_orderkey || '.1' ELSE 'p' || o_orderkey END AS protein,
   CASE WHEN o_orderkey % 2 = 0 THEN 'rna-m' ELSE 'm' END || o_orderkey AS mrna,
   'L' || CASE WHEN o_orderkey % 20 = 4 THEN -o_orderkey ELSE o_orderkey // 7 END AS lt FROM orders),
 pr AS (SELECT protein, protein || CASE WHEN k % 3 = 0 THEN ' [gene=G' || g || ']' ELSE '' END AS header, k % 500 + 50 AS length FROM od WHERE k % 13 > 0)"""
RECORDS = """ex AS (SELECT l_orderkey AS k, l_partkey AS s, l_partkey + CAST(l_quantity AS BIGINT) AS e FROM lineitem GROUP BY ALL),
 lo AS (SELECT k, string_agg('<' || s || '..>' || e, ',' ORDER BY s DESC, e DESC) AS spans, string_agg(s || '-' || e, '|' ORDER BY s, e) AS fp FROM ex GROUP BY k),
 rc AS (SELECT 2 * od.k AS row, od.k, c % 300 + 100 AS length, CASE od.k % 10 WHEN 0 THEN 'r' || od.k || ' [protein_id=' || protein || ']' WHEN 1 THEN 'r' || od.k || ' polypeptide=' || protein || ' x'
     WHEN 2 THEN 'r' || od.k || ' [location=complement(join(' || coalesce(spans, '') || '))]' WHEN 3 THEN 'r' || od.k || ' [transcript_id=m' || od.k || ']' WHEN 4 THEN 'r' || od.k || ' [locus_tag=' || lt || ']'
     WHEN 5 THEN 'r' || od.k || ' [gene=G' || g || ']' WHEN 6 THEN 'r' || od.k || ' [db_xref=GeneID:' || gn || ']' WHEN 7 THEN 'p' || od.k || ' some text' WHEN 8 THEN 'p' || od.k ELSE 'lcl|NC_1_cds_P' || od.k || '.1_5' END
     || CASE od.k % 4 WHEN 0 THEN ' [gbkey=mRNA]' WHEN 1 THEN ' [gbkey=misc_RNA]' WHEN 2 THEN ' XM_1' ELSE '' END AS header FROM od LEFT JOIN lo ON lo.k = od.k
   UNION ALL SELECT 2 * k + 1, k, c % 200 + 150, 's' || k || ' [protein_id=' || protein || '] ' || CASE WHEN k % 6 = 0 THEN '[gbkey=CDS]' ELSE 'XR_1' END FROM od WHERE k % 5 < 3)"""
MATCHED = f"""{PR}, {RECORDS},
 fp AS (SELECT fp AS key, min(protein) AS protein FROM lo JOIN od ON od.k = lo.k GROUP BY 1 HAVING count(DISTINCT protein) = 1),
 ak AS (SELECT lt AS key, protein FROM od UNION ALL SELECT unnest(['N' || g, 'G' || g, 'LG' || g, 'GeneID:' || gn]), protein FROM od),
 kk AS (SELECT key, min(protein) AS protein FROM ak GROUP BY 1 HAVING count(DISTINCT protein) = 1 UNION ALL SELECT unnest(list_distinct([mrna, 'm' || k])), protein FROM od),
 cd AS (SELECT row, 1 AS i, regexp_extract(header, '\\[protein_id=([^\\]]+)\\]', 1) AS t FROM rc UNION ALL SELECT row, 1, regexp_extract(header, 'polypeptide=([^ ]+)', 1) FROM rc
   UNION ALL SELECT row, 2, fp.protein FROM rc JOIN lo ON lo.k = rc.k JOIN fp ON fp.key = lo.fp WHERE header LIKE '%location=%'
   UNION ALL SELECT row, 3, protein FROM rc JOIN kk ON key = regexp_extract(header, '\\[transcript_id=([^\\]]+)\\]', 1) UNION ALL SELECT row, 4, protein FROM rc JOIN kk ON key = regexp_extract(header, '\\[locus_tag=([^\\]]+)\\]', 1)
   UNION ALL SELECT row, 5, protein FROM rc JOIN kk ON key = regexp_extract(header, '\\[gene=([^\\]]+)\\]', 1) UNION ALL SELECT row, 6, protein FROM rc JOIN kk ON key = 'GeneID:' || regexp_extract(header, 'GeneID:([0-9]+)', 1)
   UNION ALL SELECT row, 7, split_part(header, ' ', 1) FROM rc UNION ALL SELECT row, 8, split_part(header, ' ', 1) || '.p' FROM rc UNION ALL SELECT row, 9, regexp_extract(header, '_cds_([A-Za-z0-9]+\\.\\d+)_', 1) FROM rc),
 fi AS (SELECT row, min(i) AS i, arg_min(t, i) AS protein FROM cd SEMI JOIN pr ON pr.protein = cd.t GROUP BY row),
 ma AS (SELECT rc.row, rc.header, rc.length, fi.protein, ['ExplicitID', 'Fingerprint', 'TransMap', 'LocusMap', 'GeneMap', 'GeneIDMap', 'SimpleID', 'SimpleID_p', 'LCLFallback'][fi.i] AS rule FROM rc LEFT JOIN fi ON fi.row = rc.row),
 sc AS (SELECT *, CASE WHEN upper(header) LIKE '%GBKEY=MRNA%' OR upper(header) LIKE '%GBKEY=CDS%' OR contains(header, 'XM_') OR contains(header, 'NM_') THEN 2 WHEN upper(header) LIKE '%GBKEY=MISC\\_RNA%' ESCAPE '\\' OR contains(header, 'XR_') THEN 0 ELSE 1 END AS a FROM ma WHERE protein IS NOT NULL),
 be AS (SELECT *, row_number() OVER (PARTITION BY protein ORDER BY a DESC, length DESC, row) AS rn, first_value(header) OVER (PARTITION BY protein ORDER BY a DESC, length DESC, row) AS kept FROM sc)"""


def orders(spark, sf):
    k, c, s = F.col("o_orderkey"), F.col("o_custkey"), lambda x: x.cast("string")
    own = (k % 10).isin(5, 6) & (k % 3 > 0)
    protein = F.when(k % 10 == 8, F.concat(F.lit("p"), s(k), F.lit(".p"))).when(k % 10 == 9, F.concat(F.lit("P"), s(k), F.lit(".1"))).otherwise(F.concat(F.lit("p"), s(k)))
    return table(spark, sf, "orders").select(
        k.alias("k"), c.alias("c"), F.when(own, F.concat(F.lit("u"), s(k))).otherwise(F.concat(F.lit("c"), s(c))).alias("g"), F.when(own, k).otherwise(c + 10**12).alias("gn"), protein.alias("protein"),
        F.concat(F.when(k % 2 == 0, F.lit("rna-m")).otherwise(F.lit("m")), s(k)).alias("mrna"),
        F.concat(F.lit("L"), s(F.when(k % 20 == 4, -k).otherwise(F.floor(k / 7)))).alias("lt"))


def exons(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("s"), (F.col("l_partkey") + F.col("l_quantity").cast("bigint")).alias("e")).distinct()


def proteins(spark, sf):
    return orders(spark, sf).filter("k % 13 > 0").select("protein", F.concat("protein", F.when(F.col("k") % 3 == 0, F.concat(F.lit(" [gene=G"), "g", F.lit("]"))).otherwise(F.lit(""))).alias("header"), (F.col("k") % 500 + 50).alias("length"))


def features(spark, sf):
    o = orders(spark, sf)
    none, text = F.lit(None).cast("bigint"), lambda t, c: F.concat(F.lit(t), F.col(c).cast("string"))
    attrs = lambda **kv: F.map_from_arrays(F.array(*map(F.lit, kv)), F.array(*kv.values())).alias("attrs")
    row = lambda n: (F.col("k") * 8 + n).alias("row")
    mrna = o.select(row(0), F.lit("mRNA").alias("type"), none.alias("start"), none.alias("end"), attrs(ID=F.col("mrna"), Parent=text("gene-", "g"), locus_tag=F.col("lt")))
    # a first coding row of every eleventh transcript names another protein; the last one counts
    wrong = o.filter("k % 11 = 0").select(row(1), F.lit("CDS"), none, none, attrs(Parent=F.col("mrna"), protein_id=text("zz", "k")))
    cds = o.select(row(2), F.lit("CDS"), none, none, attrs(Parent=F.concat("mrna", F.lit(",other")), protein_id=F.col("protein")))
    gene = o.groupBy("g", "gn").agg(F.min("k").alias("k")).select(row(3), F.lit("gene"), none, none, attrs(ID=text("gene-", "g"), Name=text("N", "g"), locus_tag=text("LG", "g"), gene=text("G", "g"), Dbxref=F.concat(F.lit("taxon:1,"), text("GeneID:", "gn"))))
    exon = exons(spark, sf).join(o.select("k", "mrna"), "k").select(row(4), F.lit("exon"), F.col("s"), F.col("e"), attrs(Parent=F.col("mrna")))
    return mrna.union(wrong).union(cds).union(gene).union(exon)


def records(spark, sf):
    s = lambda c: F.col(c).cast("string")
    spans = exons(spark, sf).groupBy("k").agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("s", "e")))), lambda x: F.concat(F.lit("<"), x["s"].cast("string"), F.lit("..>"), x["e"].cast("string"))), ",").alias("spans"))
    o = orders(spark, sf).join(spans, "k", "left")
    r, m = F.concat(F.lit("r"), s("k")), F.col("k") % 10
    tagged = lambda tag, v: F.concat(r, F.lit(f" [{tag}="), v, F.lit("]"))
    style = (
        F.when(m == 0, tagged("protein_id", F.col("protein"))).when(m == 1, F.concat(r, F.lit(" polypeptide="), "protein", F.lit(" x")))
        .when(m == 2, F.concat(r, F.lit(" [location=complement(join("), F.coalesce("spans", F.lit("")), F.lit("))]"))).when(m == 3, tagged("transcript_id", F.concat(F.lit("m"), s("k"))))
        .when(m == 4, tagged("locus_tag", F.col("lt"))).when(m == 5, tagged("gene", F.concat(F.lit("G"), "g"))).when(m == 6, tagged("db_xref", F.concat(F.lit("GeneID:"), s("gn"))))
        .when(m == 7, F.concat(F.lit("p"), s("k"), F.lit(" some text"))).when(m == 8, F.concat(F.lit("p"), s("k"))).otherwise(F.concat(F.lit("lcl|NC_1_cds_P"), s("k"), F.lit(".1_5")))
    )
    kind = F.col("k") % 4
    tail = F.when(kind == 0, " [gbkey=mRNA]").when(kind == 1, " [gbkey=misc_RNA]").when(kind == 2, " XM_1").otherwise("")
    a = o.select((F.col("k") * 2).alias("row"), F.concat(style, tail).alias("header"), (F.col("c") % 300 + 100).alias("length"))
    second = F.concat(F.lit("s"), s("k"), F.lit(" [protein_id="), "protein", F.lit("] "), F.when(F.col("k") % 6 == 0, "[gbkey=CDS]").otherwise("XR_1"))
    return a.union(o.filter("k % 5 < 3").select(F.col("k") * 2 + 1, second, F.col("c") % 200 + 150))


def matched(spark, sf):
    return R.match_records(records(spark, sf), features(spark, sf), proteins(spark, sf))


@query("match_records", f"WITH {MATCHED} SELECT row, header, length, protein, rule FROM ma")
def match_records(spark, sf):
    return matched(spark, sf)


@query(
    "sequence_report",
    f"""WITH {MATCHED}, odd AS (SELECT *, row_number() OVER (PARTITION BY protein ORDER BY a DESC, length DESC, row) AS ro FROM sc WHERE row % 2 = 1)
    SELECT pr.protein, pr.length, be.length AS cds_length, coalesce(be.rule, 'Missing') AS cds_rule, odd.length AS cdna_length, coalesce(odd.rule, 'Missing') AS cdna_rule
    FROM pr LEFT JOIN be ON be.protein = pr.protein AND rn = 1 LEFT JOIN odd ON odd.protein = pr.protein AND ro = 1""",
)
def sequence_report(spark, sf):
    m = matched(spark, sf)
    return R.sequence_report(proteins(spark, sf), cds=m, cdna=m.filter("row % 2 = 1"))


@query("missing_proteins", f"WITH {MATCHED} SELECT protein, coalesce(nullif(regexp_extract(header, '\\[gene=([^\\]]+)\\]', 1), ''), 'NA') AS gene, header FROM pr ANTI JOIN sc ON sc.protein = pr.protein")
def missing_proteins(spark, sf):
    return R.missing_proteins(proteins(spark, sf), matched(spark, sf))


@query("headers_not_kept", f"WITH {MATCHED} SELECT protein, kept, header FROM be WHERE rn > 1 AND header <> kept")
def headers_not_kept(spark, sf):
    return R.headers_not_kept(matched(spark, sf))
