"""Alignment assembly, overlap classes and similarity joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import seq as S
from ..operators import align as B
from ..operators import overlap as O
from ..operators import similarity as K
from ..operators.match import resolve_own_feature
from ..session import kept_table, scratch_path
from ..sources.files import folder_name, read_maf
from .registry import query, table
from .sequence_queries import BEST, CHAINS, DNA, LETTERS, PLAIN, REF, ROW, block_rows, dna
from .tree_queries import _id
from .views import IV, iv

# blocks: an order is an exon and each of its lines a block with the letters of a part name
BK = f"""b0 AS (SELECT l_orderkey AS exon, CAST(l_linenumber AS BIGINT) AS block_ix, min(l_partkey) AS p, max(l_quantity) AS q, min(l_returnflag) AS f FROM lineitem GROUP BY ALL),
 b1 AS (SELECT b0.*, replace(p_name, ' ', '') AS t FROM b0 JOIN part ON p_partkey = p),
 br AS (SELECT exon, block_ix, 'ref' AS taxon, f AS contig, translate(t, '{LETTERS}', '{PLAIN}') AS text FROM b1
   UNION ALL SELECT exon, block_ix, 'A', f, translate(t, '{LETTERS}', '{ROW}') FROM b1 WHERE q > 20 UNION ALL SELECT exon, block_ix, 'B', f, reverse(translate(t, '{LETTERS}', '{PLAIN}')) FROM b1 WHERE f = 'R'),
 st AS (SELECT o_orderkey AS exon, CASE WHEN o_orderstatus = 'F' THEN '-' ELSE '+' END AS strand, o_custkey AS locus FROM orders),
 gr AS (SELECT b1.exon, b1.block_ix, tx.taxon, coalesce(br.text, repeat('-', length(t))) AS text, br.contig FROM b1 JOIN (SELECT DISTINCT exon, taxon FROM br) tx ON tx.exon = b1.exon
   LEFT JOIN br ON br.exon = b1.exon AND br.block_ix = b1.block_ix AND br.taxon = tx.taxon),
 cc AS (SELECT g.exon, taxon, strand, CASE WHEN strand = '-' THEN translate(reverse(string_agg(text, '' ORDER BY block_ix)), 'ATCG', 'TAGC') ELSE string_agg(text, '' ORDER BY block_ix) END AS text,
   arg_max(contig, block_ix) FILTER (contig IS NOT NULL) AS contig FROM gr g JOIN st ON st.exon = g.exon GROUP BY g.exon, taxon, strand)"""


def texts(spark, sf):
    x = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("exon"), F.col("l_linenumber").cast("bigint").alias("block_ix")).agg(
        F.min("l_partkey").alias("p"), F.max("l_quantity").alias("q"), F.min("l_returnflag").alias("f"))
    x = x.join(table(spark, sf, "part"), F.col("p") == F.col("p_partkey")).withColumn("t", F.replace("p_name", F.lit(" "), F.lit("")))
    plain = F.translate("t", LETTERS, PLAIN)
    kinds = F.array_compact(F.array(
        F.struct(F.lit("ref").alias("taxon"), plain.alias("text")),
        F.when(F.col("q") > 20, F.struct(F.lit("A").alias("taxon"), F.translate("t", LETTERS, ROW).alias("text"))),
        F.when(F.col("f") == "R", F.struct(F.lit("B").alias("taxon"), F.reverse(plain).alias("text")))))
    rows = x.select("exon", "block_ix", F.col("f").alias("contig"), F.explode(kinds).alias("k")).select("exon", "block_ix", "contig", "k.*")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("exon"), F.when(F.col("o_orderstatus") == "F", "-").otherwise("+").alias("strand"), F.col("o_custkey").alias("locus"))
    return rows, x.select("exon", "block_ix", F.length("t").alias("n_cols")), o


@query("concat_blocks", f"WITH {BK} SELECT exon, taxon, text, contig, strand FROM cc")
def concat(spark, sf):
    r, b, o = texts(spark, sf)
    return B.concat_blocks(r, b, o.select("exon", "strand"))


@query(
    "stitch_exons",
    f"""WITH {BK}, ex AS (SELECT st.locus, st.exon, st.strand, max(length(text)) AS n FROM cc JOIN st ON st.exon = cc.exon GROUP BY ALL), hd AS (SELECT DISTINCT locus, taxon, taxon || '.' || contig AS header FROM cc JOIN st ON st.exon = cc.exon),
    g AS (SELECT ex.locus, hd.taxon, hd.header, string_agg(coalesce(cc.text, repeat('-', n)), '' ORDER BY CASE WHEN ex.strand = '-' THEN -ex.exon ELSE ex.exon END, ex.exon) AS text
      FROM ex JOIN hd ON hd.locus = ex.locus LEFT JOIN cc ON cc.exon = ex.exon AND cc.taxon = hd.taxon AND cc.taxon || '.' || cc.contig = hd.header GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY locus, taxon ORDER BY length(replace(text, '-', '')) DESC, header) AS rn FROM g) SELECT locus, taxon, header, text FROM r WHERE rn = 1""",
)
def stitch(spark, sf):
    _, _, o = texts(spark, sf)
    c = kept_table(concat(spark, sf), "aligned")  # read for the rows and for the widths
    rows = c.select("exon", "taxon", F.concat_ws(".", "taxon", "contig").alias("header"), "text")
    ex = c.groupBy("exon").agg(F.max(F.length("text")).alias("n_cols")).join(o, "exon").select("locus", "exon", F.col("exon").alias("start"), "strand", "n_cols")
    return B.stitch_exons(rows, ex)


@query(
    "dominant_blocks",
    f"""WITH {BEST}, k AS (SELECT exon, taxon, block_ix, contig, strand, start, size FROM best WHERE taxon <> 'ASIA' UNION ALL SELECT exon, taxon, block_ix, contig, '+', start, size FROM bl WHERE taxon = 'ASIA')
    SELECT * FROM k SEMI JOIN (SELECT DISTINCT exon, block_ix FROM bl WHERE taxon = 'ASIA') r ON r.exon = k.exon AND r.block_ix = k.block_ix""",
)
def dominant_blocks(spark, sf):
    r = block_rows(spark, sf).withColumn("strand", F.lit("+")).withColumn("text", F.repeat(F.lit("A"), F.col("size").cast("int")))
    return B.dominant_blocks(r, "ASIA", 700)[0].drop("text")


def pieces(spark, sf):
    r = block_rows(spark, sf)
    return r.select(
        F.col("exon").alias("locus"), "taxon", F.col("block_ix").alias("exon"), F.col("block_ix").alias("ix"), F.col("block_ix").alias("col"), "contig", F.lit("+").alias("strand"), "start",
        (F.col("start") + F.col("size")).alias("end"), F.col("size").alias("bases"), (F.col("block_ix") * 60).alias("r_start"), (F.col("block_ix") * 60 + F.col("size") - 1).alias("r_end"),
        F.rpad(F.repeat(F.lit("A"), F.col("size").cast("int")), 50, "-").alias("text"))


# a piece is a block of 50 columns at its index, the dominant chain is the one with most bases
DOM = f"""WITH {CHAINS}, dm AS (SELECT exon, taxon, contig AS dc, chain AS dn, min(start) AS lo, max(e) AS hi FROM ch GROUP BY exon, taxon, contig, chain
   QUALIFY row_number() OVER (PARTITION BY exon, taxon ORDER BY sum(size) DESC, count(*) DESC, max(e) - min(start), contig, chain) = 1),
 kp AS (SELECT ch.*, dc, lo, hi, contig = dc AND chain = dn AS kept FROM ch JOIN dm ON dm.exon = ch.exon AND dm.taxon = ch.taxon)"""


@query("collinear_rows", f"""{DOM} SELECT exon AS locus, taxon, string_agg(rpad(CASE WHEN kept THEN repeat('A', size) ELSE '' END, 50, '-'), '' ORDER BY block_ix) AS text, any_value(dc) AS contig, '+' AS strand FROM kp GROUP BY exon, taxon""")
def collinear_rows(spark, sf):
    return B.collinear_rows(pieces(spark, sf), 600)[0]


@query(
    "collinear_mask",
    f"""{DOM} SELECT exon AS locus, taxon, block_ix AS exon, block_ix * 60 AS r_start, block_ix * 60 + size - 1 AS r_end,
      CASE WHEN contig <> dc THEN 'other contig' WHEN greatest(e, hi) - least(start, lo) > 600 THEN 'beyond 600 bp' ELSE 'not collinear' END AS reason FROM kp WHERE NOT kept""",
)
def collinear_mask(spark, sf):
    return B.collinear_rows(pieces(spark, sf), 600)[1]


# block files: a supplier is an exon of the locus of its nation, a line is a block; A changes strand, B leaves out some exons
MAF = f"""RECURSIVE l0 AS (SELECT l_suppkey AS s, l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS ln, min(l_partkey) AS p, max(l_quantity) AS q, min(l_returnflag) AS f FROM lineitem GROUP BY ALL),
 l1 AS (SELECT l0.*, s_nationkey AS locus, replace(p_name, ' ', '') AS t, ln % 3 = 0 AS more FROM l0 JOIN part ON p_partkey = p JOIN supplier ON s_suppkey = s),
 l2 AS (SELECT *, CASE WHEN more THEN '-A' ELSE 'A' END || translate(t, '{LETTERS}', '{REF}') AS r, CASE WHEN more THEN 'GC' ELSE 'C' END || translate(t, '{LETTERS}', '{ROW}') AS a,
   CASE WHEN more THEN 'TG' ELSE 'G' END || translate(t, '{LETTERS}', '{PLAIN}') AS b, row_number() OVER (PARTITION BY s ORDER BY o, ln) AS ix FROM l1),
 l3 AS (SELECT *, length(replace(r, '-', '')) AS rl, length(r) AS w, s * 100000 + coalesce(sum(length(replace(r, '-', ''))) OVER (PARTITION BY s ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rs FROM l2),
 tr AS (SELECT locus, s, ix, rs, rl, w, 'A' AS taxon, CASE WHEN f = 'R' THEN '-' ELSE '+' END AS strand, a AS text, rs + 10000000 - CASE WHEN s % 7 = 0 THEN 5000000 ELSE 0 END AS ps FROM l3 WHERE q > 20
   UNION ALL SELECT locus, s, ix, rs, rl, w, 'B', '+', b, rs FROM l3 WHERE s % 4 <> 0 AND (f = 'R' OR ln % 2 = 1)),
 rc AS (SELECT s, ix, rs, unnest(range(1, w + 1)) AS i, unnest(string_split(r, '')) AS c FROM l3),
 rp AS (SELECT s, ix, i, greatest(rs + sum(CASE WHEN c <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY s, ix ORDER BY i) - 1, s * 100000) AS pos FROM rc),
 ce AS (SELECT tr.locus, tr.s, tr.taxon, tr.ix, rp.i, pos, substr(text, rp.i, 1) AS c FROM tr JOIN rp ON rp.s = tr.s AND rp.ix = tr.ix WHERE substr(text, rp.i, 1) <> '-'),
 pc AS (SELECT locus, s, taxon, strand, min(ps) AS a, max(ps + length(replace(text, '-', ''))) AS e, min(ix) AS fst, count(*) OVER (PARTITION BY s, taxon) AS n FROM tr GROUP BY locus, s, taxon, strand),
 hit AS (SELECT ce.*, tr.strand FROM ce ASOF JOIN l3 ON l3.s = ce.s AND ce.pos >= l3.rs LEFT JOIN tr ON tr.s = ce.s AND tr.ix = l3.ix AND tr.taxon = ce.taxon),
 far AS (SELECT h.s, h.taxon, h.ix, h.i, tr.strand, min(least(abs(h.pos - rs), abs(h.pos - rs - rl + 1))) AS d FROM hit h JOIN tr ON tr.s = h.s AND tr.taxon = h.taxon WHERE h.strand IS NULL GROUP BY ALL),
 near AS (SELECT far.s, far.taxon, ix, i, arg_min(far.strand, (d, fst)) AS strand FROM far JOIN pc ON pc.s = far.s AND pc.taxon = far.taxon AND pc.strand = far.strand GROUP BY ALL),
 ow AS (SELECT h.locus, h.s, h.taxon, h.ix, h.i, h.c, coalesce(h.strand, near.strand) AS strand FROM hit h LEFT JOIN near ON near.s = h.s AND near.taxon = h.taxon AND near.ix = h.ix AND near.i = h.i),
 en AS (SELECT pc.*, bases, CASE WHEN pc.strand = '-' THEN -e ELSE a END AS u, CASE WHEN pc.strand = '-' THEN -a ELSE e END AS v, row_number() OVER (PARTITION BY locus, pc.taxon, pc.strand ORDER BY pc.s) AS rn
   FROM pc JOIN (SELECT s, taxon, strand, count(*) AS bases FROM ow GROUP BY ALL) x ON x.s = pc.s AND x.taxon = pc.taxon AND x.strand = pc.strand),
 ch AS (SELECT locus, taxon, strand, s, a, e, bases, n, rn, v, s AS chain, u AS cu FROM en WHERE rn = 1 UNION ALL
   SELECT en.locus, en.taxon, en.strand, en.s, en.a, en.e, en.bases, en.n, en.rn, en.v, CASE WHEN en.u < ch.v OR en.v > ch.cu + 700000 THEN en.s ELSE ch.chain END, CASE WHEN en.u < ch.v OR en.v > ch.cu + 700000 THEN en.u ELSE ch.cu END
   FROM ch JOIN en ON en.locus = ch.locus AND en.taxon = ch.taxon AND en.strand = ch.strand AND en.rn = ch.rn + 1),
 dm AS (SELECT locus, taxon, strand, chain, min(a) AS lo, max(e) AS hi FROM ch GROUP BY locus, taxon, strand, chain QUALIFY row_number() OVER (PARTITION BY locus, taxon ORDER BY sum(bases) DESC, count(*) DESC, max(e) - min(a), strand) = 1),
 kp AS (SELECT ch.*, ch.strand = dm.strand AND ch.chain = dm.chain AS kept, dm.strand AS ds, lo, hi FROM ch JOIN dm ON dm.locus = ch.locus AND dm.taxon = ch.taxon)"""
TURN = "CASE WHEN locus % 2 = 1 THEN translate(reverse(x), 'ATCG', 'TAGC') ELSE x END"


def from_blocks(spark, sf):
    li = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("bigint").alias("ln")).agg(
        F.min("l_partkey").alias("p"), F.max("l_quantity").alias("q"), F.min("l_returnflag").alias("f"))
    x = li.join(table(spark, sf, "part").select(F.col("p_partkey").alias("p"), F.replace("p_name", F.lit(" "), F.lit("")).alias("t")), "p")
    text = lambda more, first, to: F.concat(F.when(F.col("ln") % 3 == 0, more).otherwise(""), F.lit(first), F.translate("t", LETTERS, to))
    x = x.withColumns({"r": text("-", "A", REF), "a": text("G", "C", ROW), "b": text("T", "G", PLAIN)}).withColumn("rl", F.length(S.ungap("r")))
    before = Window.partitionBy("s").orderBy("o", "ln").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("rs", F.col("s") * 100000 + F.coalesce(F.sum("rl").over(before), F.lit(0)))

    def line(name, at, strand, col):
        n = F.length(S.ungap(col))
        start = F.when(strand == "-", 10**12 - at - n).otherwise(at)
        return F.concat_ws(" ", F.lit("\ns"), F.lit(name), start.cast("string"), n.cast("string"), strand, F.lit(str(10**12)), F.col(col))

    a = line("A.c", F.col("rs") + 10000000 - F.when(F.col("s") % 7 == 0, 5000000).otherwise(0), F.when(F.col("f") == "R", "-").otherwise("+"), "a")
    b = line("B.d", F.col("rs"), F.lit("+"), "b")
    block = F.concat(F.lit("a score=1"), line("ref.chr", F.col("rs"), F.lit("+"), "r"), F.when(F.col("q") > 20, a).otherwise(""),
                     F.when((F.col("s") % 4 != 0) & ((F.col("f") == "R") | (F.col("ln") % 2 == 1)), b).otherwise(""), F.lit("\n"))
    path = scratch_path(spark, "blocks")
    x.select("s", "o", "ln", block.alias("value")).repartition("s").sortWithinPartitions("s", "o", "ln").select("s", "value").write.partitionBy("s").text(path)
    blocks, rows = read_maf(spark, path, index=True, name=folder_name)
    to_id = lambda df: df.withColumn("exon", F.col("exon").cast("bigint"))
    blocks, rows = to_id(blocks), kept_table(to_id(rows), "block-rows")
    sup = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("exon"), F.col("s_nationkey").alias("locus"), F.when(F.col("s_nationkey") % 2 == 1, "-").otherwise("+").alias("strand"))
    exons = blocks.groupBy("exon").agg(F.min("ref_start").alias("start"), (F.max(F.col("ref_start") + F.col("ref_len")) - 1).alias("end")).join(sup, "exon")
    width = rows.groupBy("exon", "block_ix").agg(F.max(F.length("text")).alias("n_cols"))
    aligned = B.concat_blocks(rows, width, sup.select("exon", "strand")).join(sup.select("exon", "locus"), "exon")
    return B.collinear_from_blocks(aligned.select("locus", "exon", "taxon", "contig", "text"), exons, rows, "ref", 700000)


@query(
    "block_rows_collinear",
    f"""WITH {MAF}, al AS (SELECT l3.locus, dm.taxon, l3.s, l3.ix, rc.i, CASE WHEN kept THEN ow.c ELSE '-' END AS c FROM l3 JOIN rc ON rc.s = l3.s AND rc.ix = l3.ix JOIN dm ON dm.locus = l3.locus
      LEFT JOIN ow ON ow.s = l3.s AND ow.taxon = dm.taxon AND ow.ix = l3.ix AND ow.i = rc.i LEFT JOIN kp ON kp.s = ow.s AND kp.taxon = ow.taxon AND kp.strand = ow.strand),
    te AS (SELECT locus, taxon, string_agg(c, '' ORDER BY s, ix, i) AS x FROM al GROUP BY ALL UNION ALL SELECT locus, 'ref', string_agg(r, '' ORDER BY s, ix) FROM l3 GROUP BY locus)
    SELECT locus, taxon, CASE taxon WHEN 'A' THEN 'c' WHEN 'B' THEN 'd' END AS contig, {TURN} AS text FROM te""",
)
def block_rows_collinear(spark, sf):
    return from_blocks(spark, sf)[0]


@query(
    "block_rows_log",
    f"""WITH {MAF} SELECT locus, taxon, CASE taxon WHEN 'A' THEN 'c' ELSE 'd' END AS contig, ds AS strand, CAST(1 AS BIGINT) AS n_rows, count(*) FILTER (kept) AS n_kept, count(*) AS n_pieces,
      CAST(coalesce(sum(bases) FILTER (kept), 0) AS BIGINT) AS kept_bases, CAST(coalesce(sum(bases) FILTER (NOT kept), 0) AS BIGINT) AS gapped_bases FROM kp GROUP BY locus, taxon, ds""",
)
def block_rows_log(spark, sf):
    return from_blocks(spark, sf)[1]


@query(
    "block_rows_mask",
    f"""WITH {MAF}, ex AS (SELECT s, locus, min(rs) AS a, max(rs + rl) - 1 AS e FROM l3 GROUP BY ALL),
    wh AS (SELECT *, CASE WHEN strand <> ds THEN 'opposite strand' WHEN greatest(e, hi) - least(a, lo) > 700000 THEN 'beyond 700000 bp' ELSE 'not collinear' END AS reason FROM kp WHERE NOT kept),
    inn AS (SELECT DISTINCT ce.s, ce.taxon FROM ce JOIN ex ON ex.s = ce.s WHERE pos < ex.e)
    SELECT ex.locus, dm.taxon, ex.s AS exon, CAST(ex.a AS BIGINT) AS r_start, CAST(ex.e AS BIGINT) AS r_end, CASE WHEN pc.s IS NULL THEN 'absent' ELSE 'absent (padding only)' END AS reason
      FROM ex JOIN dm ON dm.locus = ex.locus LEFT JOIN (SELECT DISTINCT s, taxon FROM ce) pc ON pc.s = ex.s AND pc.taxon = dm.taxon LEFT JOIN inn ON inn.s = ex.s AND inn.taxon = dm.taxon WHERE inn.s IS NULL
    UNION ALL SELECT wh.locus, wh.taxon, wh.s, CAST(ex.a AS BIGINT), CAST(ex.e AS BIGINT), reason FROM wh JOIN ex ON ex.s = wh.s WHERE n = 1
    UNION ALL SELECT wh.locus, wh.taxon, wh.s, CAST(rs AS BIGINT), CAST(rs + rl AS BIGINT), reason FROM wh JOIN tr ON tr.s = wh.s AND tr.taxon = wh.taxon AND tr.strand = wh.strand WHERE n = 2""",
)
def block_rows_mask(spark, sf):
    return from_blocks(spark, sf)[2]


# two exons, the halves of a text; sixteen kinds of reference rows, exons, sequences and files by id, short texts of kind 3
TRIM = DNA + """, t0 AS (SELECT doc_id, coalesce(dna, '') AS dna FROM dna), t1 AS (SELECT *, length(dna) AS n, length(dna) // 2 AS h, CASE WHEN length(dna) < 20 THEN 3 ELSE doc_id % 16 END AS m, (doc_id // 16) % 2 = 1 AS minus FROM t0),
  t2 AS (SELECT *, left(dna, h) AS a, substr(dna, h + 1) AS b FROM t1),
  t3 AS (SELECT *, CASE WHEN m = 0 AND minus THEN '-A' || a || 'C' || b WHEN m = 0 THEN '-' || a || 'A' || b || 'C' WHEN m = 1 THEN left(dna, 3) || '-' || substr(dna, 4)
   WHEN m = 2 AND minus THEN a || '-A' || b WHEN m = 2 THEN a || 'A-' || b WHEN m = 3 THEN dna || 'AAAAA' WHEN m = 11 THEN 'N' || substr(dna, 2)
   WHEN m = 12 AND minus THEN 'T' || left(a, h - 1) || 'T' || left(b, n - h - 1) WHEN m = 12 THEN substr(a, 2) || 'T' || substr(b, 2) || 'T' WHEN m = 13 THEN translate(left(dna, 1), 'ACGT', 'CATG') || substr(dna, 2) ELSE dna END AS ref FROM t2),
  t4 AS (SELECT *, left(ref, h) AS ra, substr(ref, h + 1) AS rb FROM t3),
  tr AS (SELECT *, CASE m WHEN 3 THEN 'UNEXPECTED_REFERENCE_LENGTH' WHEN 4 THEN 'ROW_LENGTHS_DIFFER' WHEN 5 THEN 'NO_TRANSCRIPT_MATCH' WHEN 6 THEN 'NOT_IN_FNA' WHEN 7 THEN 'DUPLICATE_FNA_ID' WHEN 8 THEN 'BED_FNA_LENGTH_MISMATCH'
    WHEN 9 THEN CASE WHEN doc_id % 32 = 9 THEN 'NO_REFERENCE_ROW' ELSE 'NO_RECORDS' END WHEN 10 THEN 'MULTIPLE_REFERENCE_ROWS' WHEN 14 THEN 'TEXT_BEFORE_FIRST_HEADER' WHEN 15 THEN 'DUPLICATE_FILENAME'
    ELSE CASE WHEN m IN (0, 1, 2, 11) OR ref = dna THEN 'OK' WHEN CASE WHEN minus THEN substr(ra, 2) = left(a, h - 1) AND substr(rb, 2) = left(b, n - h - 1) ELSE left(ra, h - 1) = substr(a, 2) AND left(rb, n - h - 1) = substr(b, 2) END
      THEN 'EXTRACTION_SHIFTED' ELSE 'REFERENCE_MISMATCH_AFTER_TRIM' END END AS status, CASE WHEN m = 11 THEN ref ELSE dna END AS kept FROM t4)"""


def trimmed(spark, sf):
    d = dna(spark, sf).select("doc_id", F.coalesce("dna", F.lit("")).alias("dna"))
    n = F.length("dna")
    d = d.withColumn("h", F.floor(n / 2).cast("int")).withColumn("m", F.when(n < 20, 3).otherwise(F.col("doc_id") % 16)).withColumn("minus", F.floor(F.col("doc_id") / 16) % 2 == 1)
    d = d.withColumn("a", F.expr("left(dna, h)")).withColumn("b", F.expr("substr(dna, h + 1)"))
    text = lambda p, q: F.when(F.col("minus"), F.expr(q)).otherwise(F.expr(p))
    kinds = {
        0: text("'-' || a || 'A' || b || 'C'", "'-A' || a || 'C' || b"), 1: F.expr("left(dna, 3) || '-' || substr(dna, 4)"), 2: text("a || 'A-' || b", "a || '-A' || b"),
        3: F.expr("dna || 'AAAAA'"), 11: F.expr("'N' || substr(dna, 2)"),
        12: text("substr(a, 2) || 'T' || substr(b, 2) || 'T'", "'T' || left(a, length(a) - 1) || 'T' || left(b, length(b) - 1)"), 13: F.expr("translate(left(dna, 1), 'ACGT', 'CATG') || substr(dna, 2)")}
    ref = F.col("dna")
    for k, v in kinds.items():
        ref = F.when(F.col("m") == k, v).otherwise(ref)
    x = d.withColumn("ref", ref)
    row = lambda taxon, t, is_ref: F.struct(F.lit(taxon).alias("taxon"), t.alias("text"), F.lit(is_ref).alias("is_ref"))
    other = F.translate("ref", "AC-", "-AT")
    m = F.col("m")
    made = F.array_compact(F.array(
        F.when(~m.isin(9), row("ref", F.col("ref"), True)), F.when(m == 10, row("ref", F.col("ref"), True)),
        F.when((m != 9) | (F.col("doc_id") % 32 == 9), row("A", F.when(m == 4, F.concat(other, F.lit("-"))).otherwise(other), False))))
    locus = F.col("doc_id").alias("locus")
    rows = x.select(locus, F.explode(made).alias("r")).select("locus", "r.*")
    z = lambda c: c.cast("bigint")
    ex = x.filter("m <> 5").select(locus, F.when(F.col("minus"), 0).otherwise(1).alias("starts_right"), F.array(z(F.col("h")), z(F.length("dna") - F.col("h") + F.when(m == 8, 1).otherwise(0))).alias("lens"),
                                   F.when(F.col("minus"), "-").otherwise("+").alias("strand"))
    cds = x.filter("m <> 6").select(locus, F.explode(F.when(m == 7, F.array("dna", F.concat("dna", F.lit("A")))).otherwise(F.array(F.lower("dna")))).alias("cds"))
    files = x.select(locus, F.explode(F.array_repeat(m == 14, F.when(m == 15, 2).otherwise(1))).alias("preamble"))
    return B.trim_to_cds(rows, ex, cds, files)


@query("trimmed_rows", f"WITH {TRIM} SELECT doc_id AS locus, 'ref' AS taxon, kept AS text FROM tr WHERE status = 'OK' UNION ALL SELECT doc_id, 'A', translate(kept, 'AC', '-A') FROM tr WHERE status = 'OK'")
def trim_rows(spark, sf):
    return trimmed(spark, sf)[0]


@query(
    "trim_report",
    f"""WITH {TRIM}, r AS (SELECT *, status = 'OK' AS ok FROM tr)
    SELECT doc_id AS locus, CAST(CASE WHEN status = 'NO_RECORDS' THEN 0 WHEN m = 9 THEN 1 WHEN m = 10 THEN 3 ELSE 2 END AS BIGINT) AS n_taxa, status,
    CASE m WHEN 0 THEN 'one_extra_per_exon' WHEN 2 THEN 'one_extra_per_exon_except_rightmost' ELSE CASE WHEN m IN (1, 11, 12, 13) THEN 'cds_length' END END AS reference_extraction,
    CASE WHEN ok THEN length(ref) END AS n_columns, CASE WHEN ok THEN CASE m WHEN 0 THEN 2 WHEN 2 THEN 1 ELSE 0 END END AS n_extra,
    CASE WHEN ok THEN CASE WHEN m = 0 AND minus THEN '2,' || (h + 3) WHEN m = 0 THEN (h + 2) || ',' || (n + 3) WHEN m = 2 AND minus THEN '' || (h + 2) WHEN m = 2 THEN '' || (h + 1) ELSE '' END END AS extra_columns,
    CASE WHEN ok THEN CASE WHEN m < 3 THEN 1 ELSE 0 END END AS n_gap_columns, CASE WHEN ok THEN CASE WHEN m = 11 THEN '1:N/' || left(dna, 1) ELSE '' END END AS accepted,
    CASE WHEN ok THEN CASE WHEN m < 3 THEN 1 ELSE 0 END END AS bases_in_gap_columns, CASE WHEN ok THEN CASE m WHEN 0 THEN 1 ELSE 0 END END AS bases_in_extra_columns FROM r""",
)
def trim_report(spark, sf):
    return trimmed(spark, sf)[1]


@query(
    "base_count_audit",
    f"""WITH {TRIM}, a AS (SELECT doc_id, CAST(length(replace(ref, '-', '')) AS BIGINT) AS raw, CASE WHEN status = 'OK' THEN CAST(n AS BIGINT) END AS filtered, CAST(n AS BIGINT) AS written FROM tr)
    SELECT doc_id AS locus, raw, filtered, written, CASE WHEN raw = filtered AND filtered = written THEN 'PASS' ELSE 'DIFFERS' END AS status FROM a""",
)
def base_counts(spark, sf):
    d = dna(spark, sf).select(F.col("doc_id").alias("locus"), F.coalesce("dna", F.lit("")).alias("text"))
    rows, _ = trimmed(spark, sf)
    m = F.when(F.length("text") < 20, 3).otherwise(F.col("locus") % 16)
    extra = F.when(m == 0, 2).when(m == 2, 1).when(m == 3, 5).otherwise(0)
    raw = d.withColumn("text", F.concat("text", F.repeat(F.lit("A"), extra)))
    return B.base_count_audit(raw, rows.filter("taxon = 'ref'"), d)


@query(
    "length_audit",
    f"""WITH {DNA}, j AS (SELECT a.doc_id AS locus, dna, replace(qry, '-', '') AS s, length(dna) AS n FROM aln a JOIN dna USING (doc_id))
    SELECT locus, CASE WHEN length(s) = n THEN 'PASS' WHEN length(s) > 0 AND length(s) % 3 = 0 THEN 'PASS_IN_FRAME_SHORT(' || (length(s) - n) || ')' WHEN length(s) % 3 <> 0 THEN 'FAIL_FRAME_SHIFT(' || length(s) % 3 || ')' ELSE 'FAIL(' || (length(s) - n) || ')' END AS status,
    s = dna AS identical, CASE WHEN locus % 2 = 0 THEN 'MATCH' ELSE 'NA' END AS bed_check FROM j""",
)
def length_audit(spark, sf):
    from .sequence_queries import aln

    d = dna(spark, sf)
    a = aln(spark, sf).select(F.col("doc_id").alias("locus"), F.col("row_text").alias("text"))
    bed = d.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("locus"), F.length("dna").alias("n"))
    return B.length_audit(a, bed, d.select(F.col("doc_id").alias("locus"), F.col("dna").alias("cds")))


@query(
    "fix_strand",
    "SELECT o_orderkey AS locus, CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE CASE WHEN o_orderstatus = 'F' THEN '-' ELSE '+' END END AS strand, o_custkey % 2 = 0 AND o_orderstatus = 'F' AS changed FROM orders",
)
def fix_strand(spark, sf):
    o = table(spark, sf, "orders")
    s = o.select(F.col("o_orderkey").alias("locus"), F.when(F.col("o_orderstatus") == "F", "-").otherwise("+").alias("strand"))
    return B.fix_strand(s, o.filter("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("locus"), F.lit("+").alias("strand")))


@query(
    "build_cds",
    f"""WITH {DNA}, p AS (SELECT doc_id, length(dna) AS n, left(dna, length(dna) // 3) AS a, substr(dna, length(dna) // 2 + 1) AS b FROM dna),
    c AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN translate(reverse(a || b), 'ATCG', 'TAGC') ELSE a || b END AS cds FROM p)
    SELECT doc_id AS transcript, CASE WHEN doc_id % 2 = 0 THEN '-' ELSE '+' END AS strand, CAST(2 AS BIGINT) AS n_exons, cds, CAST(length(cds) AS INTEGER) AS cds_nt, CASE WHEN doc_id % 2 = 0 THEN 'mismatch' ELSE 'no_protein' END AS status FROM c""",
)
def build_cds(spark, sf):
    d = dna(spark, sf)
    n = F.length("dna")
    z = lambda c: c.cast("bigint")
    spans = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), z(F.floor(n / 3)).alias("end")), F.struct(z(F.floor(n / 2)).alias("start"), z(n).alias("end")))
    ex = d.select(F.col("doc_id").alias("transcript"), F.col("doc_id").alias("chrom"), F.when(F.col("doc_id") % 2 == 0, "-").otherwise("+").alias("strand"), F.explode(spans).alias("s"))
    # chromosomes stored in pieces of 1000 bases
    g = d.filter(n > 0).select(F.col("doc_id").alias("chrom"), "dna", F.explode(F.sequence(F.lit(0), n - 1, F.lit(1000))).alias("offset"))
    g = g.select("chrom", "offset", F.expr("substr(dna, offset + 1, 1000)").alias("seq"))
    p = d.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("transcript"), F.lit("?").alias("protein"))
    return B.build_cds(ex.select("transcript", "chrom", "strand", "s.*"), g, p)


@query("species_inputs", "SELECT DISTINCT l_orderkey AS transcript, l_returnflag AS chrom, l_linenumber * 10 AS start, l_linenumber * 10 + CAST(l_quantity AS BIGINT) AS \"end\", '+' AS strand FROM lineitem")
def species_inputs(spark, sf):
    x = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("transcript"), F.col("l_returnflag").alias("chrom"), (F.col("l_linenumber") * 10).cast("bigint").alias("start"),
                                            (F.col("l_linenumber") * 10 + F.col("l_quantity")).cast("bigint").alias("end"), F.lit("+").alias("strand"))
    s = table(spark, sf, "orders").select(F.col("o_orderkey").alias("transcript"))
    return B.species_inputs(x, s)[0]


# loci are returned shipments of a supplier, genes its other ones; strand from the line status, one coding part per gene
LOC = f"""{IV}, ge AS (SELECT 'G' || okey || '_' || k || '_' || s || '_' || e AS gene, supp AS chrom, s AS gs, e AS ge, CASE WHEN ls = 'F' THEN '-' ELSE '+' END AS g_strand FROM iv WHERE flag <> 'R'),
 lo AS (SELECT DISTINCT 'L' || okey || '_' || k || '_' || s || '_' || e || ls AS locus, supp AS chrom, s AS st, e AS en, CASE WHEN ls = 'F' THEN '-' ELSE '+' END AS strand FROM iv WHERE flag = 'R')"""


def loci(spark, sf):
    x = iv(spark, sf).withColumn("strand", F.when(F.col("ls") == "F", "-").otherwise("+"))
    text = lambda p, *more: F.concat(F.lit(p), F.concat_ws("_", *[F.col(c).cast("string") for c in ("okey", "k", "s", "e")]), *more)
    chrom = F.col("supp").cast("string").alias("chrom")
    lo = x.filter("flag = 'R'").select(text("L", F.col("ls")).alias("locus"), chrom, F.col("s").alias("start"), F.col("e").alias("end"), "strand").distinct()
    ge = x.filter("flag <> 'R'").select(text("G").alias("gene"), chrom, F.col("s").alias("g_start"), F.col("e").alias("g_end"), F.col("strand").alias("g_strand"))
    return lo, ge


@query("overlap_classes")
def overlap_classes(spark, sf):
    lo, ge = loci(spark, sf)
    lo = lo.withColumn("status", F.lit("named")).withColumn("own_gene", F.col("locus"))
    cds = ge.select("gene", F.col("g_start").alias("c_start"), (F.col("g_start") + F.floor((F.col("g_end") - F.col("g_start")) / 2)).alias("c_end"))
    return O.classify_overlap(lo, ge, cds, lo.select(F.col("locus").alias("gene")), max_gap=3)


@query(
    "own_feature",
    f"""WITH {IV}, lo AS (SELECT DISTINCT 'AT' || okey || 'G.1' AS locus, CAST(supp AS VARCHAR) AS chrom, s AS start, e AS "end" FROM iv WHERE flag = 'R'),
    ge AS (SELECT 'gene-at' || okey || 'g' AS gene, CAST(supp AS VARCHAR) AS chrom, s, e FROM iv WHERE flag = 'R' AND okey % 2 = 0 UNION ALL SELECT 'x' || okey, CAST(supp AS VARCHAR), s, e FROM iv WHERE flag <> 'R'),
    hit AS (SELECT DISTINCT lo.locus, lo.chrom, lo.start, lo."end", ge.gene FROM lo JOIN ge ON ge.chrom = lo.chrom AND ge.s <= lo."end" AND ge.e >= lo.start),
    b AS (SELECT locus, min(gene) FILTER (gene = 'gene-' || replace(lower(locus), '.1', '')) AS own FROM hit GROUP BY 1)
    SELECT lo.*, own AS own_gene, CASE WHEN b.locus IS NULL THEN 'no_gene' WHEN own IS NULL THEN 'unmatched' ELSE 'named' END AS own_status FROM lo LEFT JOIN b ON b.locus = lo.locus""",
)
def own_feature(spark, sf):
    x = iv(spark, sf)
    chrom = F.col("supp").cast("string").alias("chrom")
    span = [F.col("s").alias("g_start"), F.col("e").alias("g_end")]
    k = F.col("okey").cast("string")
    lo = x.filter("flag = 'R'").select(F.concat(F.lit("AT"), k, F.lit("G.1")).alias("locus"), chrom, F.col("s").alias("start"), F.col("e").alias("end")).distinct()
    own = x.filter("flag = 'R' and okey % 2 = 0").select(F.concat(F.lit("gene-at"), k, F.lit("g")).alias("gene"), chrom, *span)
    ge = own.unionByName(x.filter("flag <> 'R'").select(F.concat(F.lit("x"), k).alias("gene"), chrom, *span))
    alias = own.select("gene", F.concat(F.expr("substr(gene, 6)"), F.lit(".2")).alias("alias")).distinct()
    forms = lambda c: F.array_distinct(F.array(F.lower(c), F.regexp_replace(F.lower(c), r"\.\d+$", "")))
    # no span is longer than a cell, so one level does
    return resolve_own_feature(lo, ge, alias, forms, width=256, levels=1)


@query(
    "kept_span",
    f"""WITH {IV}, p AS (SELECT k, supp, flag, s, e, okey FROM iv), m AS (SELECT k, s, e FROM iv WHERE flag = 'N' AND okey % 3 = 0),
    cell AS (SELECT DISTINCT k, unnest(range(s, e + 1)) AS x FROM m),
    q AS (SELECT DISTINCT p.k, p.s, p.e, greatest(p.s, b.s) AS cs, least(p.e, b.e) AS ce FROM p JOIN iv b ON b.k = p.k AND b.flag = 'R' AND b.s <= p.e AND b.e >= p.s WHERE p.flag = 'A'),
    c AS (SELECT q.k, q.s, q.e, q.cs, q.ce, count(x) AS n FROM q LEFT JOIN cell ON cell.k = q.k AND x BETWEEN q.cs AND q.ce GROUP BY ALL),
    f AS (SELECT k, 'A' AS contig, min(s * 2) AS start, max(e * 2) AS "end", count(*) AS n_pieces FROM (SELECT DISTINCT k, s, e FROM c WHERE n < ce - cs + 1) GROUP BY k)
    SELECT a.k AS locus, 't' AS taxon, contig, start, "end", coalesce(n_pieces, 0) AS n_pieces FROM (SELECT DISTINCT k FROM iv) a LEFT JOIN f ON f.k = a.k""",
)
def kept_span(spark, sf):
    x = iv(spark, sf)
    p = x.select(F.col("k").alias("locus"), F.lit("t").alias("taxon"), F.lit("A").alias("kept_contig"), F.col("flag").alias("contig"), F.col("s").alias("r_start"), F.col("e").alias("r_end"),
                 (F.col("s") * 2).alias("t_start"), (F.col("e") * 2).alias("t_end")).distinct()
    ex = x.filter("flag = 'R'").select(F.col("k").alias("locus"), F.col("s").alias("e_start"), F.col("e").alias("e_end"))
    m = x.filter("flag = 'N' and okey % 3 = 0").select(F.col("k").alias("locus"), F.lit("t").alias("taxon"), F.col("s").alias("m_start"), F.col("e").alias("m_end"))
    return O.kept_span(ex, p, m)


def deletion_inputs(spark, sf):
    x = iv(spark, sf).select(F.col("k").alias("locus"), F.col("supp").alias("taxon"), "flag", "s", "e", "okey")
    runs = x.filter("flag = 'R'").select(F.concat_ws("_", F.col("okey").cast("string"), F.col("locus").cast("string"), F.col("taxon").cast("string"), F.col("s").cast("string"), F.col("e").cast("string")).alias("run"),
                                         "locus", "taxon", F.col("s").alias("r_start"), F.col("e").alias("r_end"), F.lit(1).alias("n_exons")).dropDuplicates(["run"])
    b = x.select("locus", "taxon", F.col("s").alias("b_start"), F.col("e").alias("b_end"), F.lit("c").alias("contig"), F.lit("+").alias("strand"), F.col("s").alias("t_start"), (F.col("e") + 1).alias("t_end"), "flag")
    return runs, b.filter("flag <> 'R'").drop("flag"), b.filter("flag = 'A'").drop("flag")


@query(
    "deletion_sources",
    f"""WITH {IV}, r AS (SELECT DISTINCT okey || '_' || k || '_' || supp || '_' || s || '_' || e AS run, k, supp, s, e FROM iv WHERE flag = 'R'), rc AS (SELECT run, k, supp, unnest(range(s, e + 1)) AS x FROM r),
    c AS (SELECT run, x, coalesce(bool_or(flag = 'A'), false) AS a, count(iv.k) > 0 AS b FROM rc LEFT JOIN iv ON iv.k = rc.k AND iv.supp = rc.supp AND flag <> 'R' AND x BETWEEN iv.s AND iv.e GROUP BY ALL),
    g AS (SELECT run, count(*) FILTER (a) AS ga, count(*) FILTER (b AND NOT a) AS dr, count(*) FILTER (NOT b) AS no FROM c GROUP BY 1)
    SELECT run, CASE WHEN dr > 0 THEN 'dropped_piece' WHEN no > 0 THEN 'no_alignment' ELSE 'aligner_gap' END AS gap_source, ga AS n_aligner_gap, dr AS n_dropped, no AS n_no_alignment FROM g""",
)
def deletion_sources(spark, sf):
    return O.deletion_evidence(*deletion_inputs(spark, sf)).select("run", "gap_source", "n_aligner_gap", "n_dropped", "n_no_alignment")


@query(
    "shared_deletions",
    f"""WITH {IV}, r AS (SELECT DISTINCT okey || '_' || k || '_' || supp || '_' || s || '_' || e AS run, k, supp, s, e FROM iv WHERE flag = 'R'), n AS (SELECT run, r.k, r.supp, s, e FROM r),
    p AS (SELECT a.run, bool_or(b.supp = a.supp // 2) AS ip, bool_or(b.supp = a.supp + 1) AS isi FROM n a JOIN n b ON a.k = b.k AND b.supp IN (a.supp // 2, a.supp + 1) AND a.supp <> b.supp AND a.s <= b.e AND b.s <= a.e GROUP BY 1)
    SELECT n.run, coalesce(ip, false) AS in_parent, coalesce(isi, false) AS in_sister FROM n LEFT JOIN p ON p.run = n.run""",
)
def shared_deletions(spark, sf):
    r, _, _ = deletion_inputs(spark, sf)
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("taxon"))
    rel = s.select("taxon", F.explode(F.array(F.struct(F.lit("parent").alias("relation"), F.floor(F.col("taxon") / 2).alias("other")), F.struct(F.lit("sister").alias("relation"), (F.col("taxon") + 1).alias("other")))).alias("r")).select("taxon", "r.*").filter("taxon <> other")
    return O.shared_with_relatives(r, rel).select("run", "in_parent", "in_sister")


def grams(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.regexp_replace(F.lower("text"), "[^a-z]", "").alias("s"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.regexp_replace(F.lower("text"), "[^a-z]", "").alias("s"))
    return K.distinct_sequences(b, "id", "s")[0], K.distinct_sequences(d, "id", "s")[0]


GRAM = """q AS (SELECT regexp_replace(lower(text), '[^a-z]', '', 'g') AS seq, min(item_id) AS rep FROM benchmark GROUP BY 1), t AS (SELECT regexp_replace(lower(text), '[^a-z]', '', 'g') AS seq, min(doc_id) AS rep FROM documents GROUP BY 1),
 kq AS (SELECT DISTINCT rep, substr(seq, p, 8) AS g FROM (SELECT rep, seq, unnest(range(1, length(seq) - 6)) AS p FROM q)), kt AS (SELECT DISTINCT rep, substr(seq, p, 8) AS g FROM (SELECT rep, seq, unnest(range(1, length(seq) - 6)) AS p FROM t)),
 nq AS (SELECT rep, count(*) AS n FROM kq GROUP BY 1), sh AS (SELECT kq.rep AS query, kt.rep AS target, count(*) AS n_shared FROM kq JOIN kt ON kq.g = kt.g GROUP BY ALL),
 pr AS (SELECT query, target, n_shared, n AS n_query FROM sh JOIN nq ON nq.rep = query WHERE n_shared >= ceil(CAST(0.6 AS DOUBLE) * n))"""


@query("kmer_pairs", f"WITH {GRAM} SELECT query, target, n_shared, n_query, n_shared / n_query AS share FROM pr")
def kmer_pairs(spark, sf):
    return K.kmer_join(*grams(spark, sf), 8, 0.6)


# shared places of a pair, then the letters they cover: a place covers up to the next one or k letters
SPANS = """kp AS (SELECT rep, substr(seq, p, 8) AS g, p FROM (SELECT rep, seq, unnest(range(1, length(seq) - 6)) AS p FROM q)), tp AS (SELECT rep, substr(seq, p, 8) AS g, p FROM (SELECT rep, seq, unnest(range(1, length(seq) - 6)) AS p FROM t SEMI JOIN pr ON t.rep = pr.target)),
 qs AS (SELECT query, target, p, lead(p) OVER (PARTITION BY query, target ORDER BY p) AS nx FROM pr JOIN kp ON kp.rep = query JOIN kt ON kt.rep = target AND kt.g = kp.g),
 ts AS (SELECT query, target, p, lead(p) OVER (PARTITION BY query, target ORDER BY p) AS nx FROM pr JOIN tp ON tp.rep = target JOIN kq ON kq.rep = query AND kq.g = tp.g),
 qc AS (SELECT query, target, sum(least(8, coalesce(nx - p, 8))) AS c FROM qs GROUP BY ALL), tc AS (SELECT query, target, sum(least(8, coalesce(nx - p, 8))) AS c FROM ts GROUP BY ALL)"""


@query(
    "kmer_spans",
    f"""WITH {GRAM}, {SPANS} SELECT pr.query, pr.target, n_shared, n_query, n_shared / n_query AS share, round(100.0 * CAST(qc.c AS DOUBLE) / length(q.seq), 2) AS query_pct, round(100.0 * CAST(tc.c AS DOUBLE) / length(t.seq), 2) AS target_pct
    FROM pr JOIN qc ON qc.query = pr.query AND qc.target = pr.target JOIN tc ON tc.query = pr.query AND tc.target = pr.target JOIN q ON q.rep = pr.query JOIN t ON t.rep = pr.target""",
)
def kmer_spans(spark, sf):
    q, t = (kept_table(x, "sequences") for x in grams(spark, sf))  # read by the join, the places and the lengths
    return K.shared_spans(K.kmer_join(q, t, 8, 0.6), q, t, 8)
