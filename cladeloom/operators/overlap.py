"""Where a locus lies relative to annotated genes, and which bases support an alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import kept_table
from .intervals import asof_join, first_overlap_join, merge_intervals, nearest_join, overlap_join, union_length


def classify_overlap(loci: DataFrame, genes: DataFrame, cds: DataFrame, locus_genes: DataFrame, max_gap: int = 1000) -> DataFrame:
    """Overlap class of each locus and the other gene it depends on.

    loci(locus, chrom, start, end, strand, status, own_gene), 1-based inclusive, with the status of the own-gene search;
    genes(gene, chrom, g_start, g_end, g_strand); cds(gene, c_start, c_end); locus_genes(gene) are the genes that loci
    stand for and never count as the other gene. By priority: coding overlap on the same strand, any overlap on the same
    strand, antisense overlap, else the side and strand of the nearest gene within max_gap, else intergenic.
    """
    # loci and genes are read by every step below, so what it takes to get them is done once
    named = kept_table(loci.filter("status = 'named'").withColumn("_c", F.lower("chrom")), "loci")
    own_genes = kept_table(locus_genes.select("gene").distinct(), "locus-genes")
    other = kept_table(genes.select("gene", F.lower("chrom").alias("_c"), "g_start", "g_end", "g_strand").join(own_genes, "gene", "left_anti"), "genes")

    own = named.select("locus", "_c", "strand", "start", "end", "own_gene").join(cds.withColumnRenamed("gene", "own_gene"), "own_gene")
    clip = kept_table(own.filter((F.col("c_start") <= F.col("end")) & (F.col("c_end") >= F.col("start"))).select(
        "locus", "_c", "strand", F.greatest("c_start", "start").alias("q_start"), F.least("c_end", "end").alias("q_end")), "clipped")
    bare = named.join(clip.select("locus").distinct(), "locus", "left_anti").select(
        "locus", "_c", "strand", F.col("start").alias("q_start"), F.col("end").alias("q_end"))
    oc = kept_table(other.join(cds, "gene").select("gene", "g_start", "_c", F.col("g_strand").alias("strand"), "c_start", "c_end"), "coding")
    coding = overlap_join(kept_table(clip.unionByName(bare), "asked"), oc, ["_c", "strand"], ("q_start", "q_end"), ("c_start", "c_end"), levels=1)
    coding = coding.groupBy("locus").agg(F.min_by("gene", F.struct("g_start", "gene")).alias("_g"))

    # a class is looked for only where no earlier one was found
    span, g_span = ("start", "end"), ("g_start", "g_end")
    cols = ["locus", "_c", "start", "end", "strand"]
    same = kept_table(named.select(*cols).join(coding, "locus", "left"), "coding-class")
    q = first_overlap_join(
        same.filter("_g is null").drop("_g"), other.select("_c", F.col("g_strand").alias("strand"), "g_start", "g_end", "gene"), ["_c", "strand"], span, g_span, "gene")
    strand = kept_table(q.select(*cols, F.col("gene").alias("_g")), "strand-class")
    q = first_overlap_join(strand.filter("_g is null").drop("_g"), other.select("_c", "g_start", "g_end", "gene"), ["_c"], span, g_span, "gene")
    anti = kept_table(q.select(*cols, F.col("gene").alias("_g")), "antisense-class")
    j = nearest_join(anti.filter("_g is null").drop("_g"), other, ["_c"], span, g_span, ["g_strand", "gene"], max_gap)
    beside = F.when(F.col("side").isNotNull(), orientation(F.col("side") == "right", F.col("strand"), F.col("g_strand"))).otherwise("intergenic")
    done = j.select("locus", beside.alias("orientation"), F.col("gene").alias("other_gene"))
    for found, name in ((same, "same_strand_cds_overlap"), (strand, "same_strand_overlap"), (anti, "antisense_overlap")):
        done = done.unionByName(found.filter("_g is not null").select("locus", F.lit(name).alias("orientation"), F.col("_g").alias("other_gene")))
    rest = loci.filter("status <> 'named'").select(
        "locus", F.when(F.col("status") == "unmatched", "own_gene_not_found").otherwise("unknown").alias("orientation"),
        F.lit(None).cast("string").alias("other_gene"))
    return done.unionByName(rest)


def orientation(locus_left: Column, strand: Column, gene_strand: Column) -> Column:
    """Placement of a locus beside a gene: upstream or downstream on its strand, divergent or convergent otherwise."""
    plus = gene_strand == "+"
    return F.when(strand == gene_strand, F.when(plus == locus_left, "up_same").otherwise("down_same")).otherwise(
        F.when(plus == locus_left, "divergent").otherwise("convergent"))


def kept_span(exons: DataFrame, pieces: DataFrame, mask: DataFrame) -> DataFrame:
    """Genomic span per (locus, taxon) of the alignment pieces whose bases were kept.

    exons(locus, e_start, e_end), pieces(locus, taxon, kept_contig, contig, r_start, r_end, t_start, t_end) in
    reference and taxon coordinates, mask(locus, taxon, m_start, m_end) in reference coordinates. A piece counts when it
    lies on the kept contig and overlaps an exon with a part, clipped to that exon, that is not wholly masked. A taxon without one
    keeps a row of NULLs.
    """
    p = pieces.filter("contig = kept_contig").withColumn("_id", F.struct("locus", "taxon", "r_start", "r_end", "t_start", "t_end"))
    clipped = overlap_join(p, exons, ["locus"], ("r_start", "r_end"), ("e_start", "e_end"))
    clipped = clipped.withColumns({"c_start": F.greatest("r_start", "e_start"), "c_end": F.least("r_end", "e_end")}).select(
        "locus", "taxon", "_id", "contig", "t_start", "t_end", "c_start", "c_end").distinct()
    m = merge_intervals(mask, ["locus", "taxon"], "m_start", "m_end")
    inside = overlap_join(clipped, m, ["locus", "taxon"], ("c_start", "c_end"), ("m_start", "m_end")).filter(
        (F.col("m_start") <= F.col("c_start")) & (F.col("m_end") >= F.col("c_end"))).select("_id", "c_start", "c_end").distinct()
    free = clipped.join(inside, ["_id", "c_start", "c_end"], "left_anti").select("locus", "taxon", "_id", "contig", "t_start", "t_end").distinct()
    spans = free.groupBy("locus", "taxon").agg(
        F.min("contig").alias("contig"), F.min("t_start").alias("start"), F.max("t_end").alias("end"), F.count("*").alias("n_pieces"))
    every = pieces.select("locus", "taxon").distinct()
    return every.join(spans, ["locus", "taxon"], "left").withColumn("n_pieces", F.coalesce("n_pieces", F.lit(0)))


def deletion_evidence(runs: DataFrame, raw: DataFrame, kept: DataFrame) -> DataFrame:
    """What stands behind the deleted bases of each run, and whether the deletion holds in place.

    runs(run, locus, taxon, r_start, r_end, n_exons); raw and kept(locus, taxon, b_start, b_end, contig, strand, t_start,
    t_end), with inclusive reference coordinates and half-open taxon coordinates: blocks as aligned, and those that
    survived filtering. A base under a kept block is a gap the aligner placed, one only under a raw block was dropped, the
    rest had no alignment. Otherwise the kept blocks on both sides are compared: the run is a likely real deletion when
    they touch in the taxon, and a possible smaller frameshift when their distances differ by no multiple of three.
    """
    key = ["locus", "taxon"]

    def covered(blocks: DataFrame, name: str) -> DataFrame:
        j = overlap_join(runs, merge_intervals(blocks, key, "b_start", "b_end"), key, ("r_start", "r_end"), ("b_start", "b_end"))
        part = j.select("run", F.greatest("r_start", "b_start").alias("s"), F.least("r_end", "b_end").alias("e"))
        return union_length(part, ["run"], "s", "e", name)

    spans = ["b_start", "b_end", "contig", "strand", "t_start", "t_end"]
    side = lambda p: kept.select(*key, F.col("b_start" if p == "l" else "b_end").alias(p + "_pos"), *[F.col(c).alias(p + "_" + c) for c in spans])
    q = runs.select("run", *key, "r_start", "r_end")
    q = asof_join(q, side("l"), key, "r_start", "l_pos", ["l_" + c for c in spans], True, False)
    q = asof_join(q, side("r"), key, "r_end", "r_pos", ["r_" + c for c in spans], False, False)
    q = q.drop(*key, "r_start", "r_end")

    j = runs.join(covered(kept, "_kept"), "run", "left").join(covered(raw, "_raw"), "run", "left").join(q, "run")
    n = F.col("r_end") - F.col("r_start") + 1
    gap, below = F.coalesce("_kept", F.lit(0)), F.coalesce("_raw", F.lit(0))
    drop, none = F.greatest(below - gap, F.lit(0)), n - F.greatest(below, gap)
    source = F.when(drop > 0, "dropped_piece").when(none > 0, "no_alignment").otherwise("aligner_gap")
    both = F.col("l_b_start").isNotNull() & F.col("r_b_start").isNotNull() & (F.col("r_b_start") > F.col("l_b_start"))
    same = both & (F.col("l_contig") == F.col("r_contig")) & (F.col("l_strand") == F.col("r_strand")) & (F.col("n_exons") == 1)
    taxon_gap = F.col("r_t_start") - F.col("l_t_end")
    diff = F.col("r_b_start") - F.col("l_b_end") - 1 - taxon_gap
    ok = F.coalesce(same & (taxon_gap >= 0), F.lit(False))
    label = (
        F.when(source == "aligner_gap", "aligner gap").when(~ok, "can't tell").when(taxon_gap == 0, "likely real deletion")
        .when(diff % 3 != 0, "possible smaller frameshift").otherwise("probably not a frameshift")
    )
    return j.select(
        "run", *key, source.alias("gap_source"), gap.cast("bigint").alias("n_aligner_gap"), drop.cast("bigint").alias("n_dropped"),
        none.cast("bigint").alias("n_no_alignment"), F.when(ok, diff).cast("bigint").alias("in_place_difference"), label.alias("evidence"))


def shared_with_relatives(runs: DataFrame, relatives: DataFrame) -> DataFrame:
    """Runs with whether the parent or a sister taxon has an overlapping run at the locus.

    relatives(taxon, relation, other) with relation parent or sister.
    """
    ask = runs.select("run", "locus", "taxon", "r_start", "r_end").join(relatives, "taxon")
    ask = ask.select("run", "relation", "locus", F.col("other").alias("taxon"), "r_start", "r_end")
    have = runs.select("locus", "taxon", F.col("r_start").alias("o_start"), F.col("r_end").alias("o_end"), F.col("run").alias("o_run"))
    hit = first_overlap_join(ask, have, ["locus", "taxon"], ("r_start", "r_end"), ("o_start", "o_end"), "o_run").filter("o_run is not null")
    g = hit.groupBy("run").agg(F.max(F.col("relation") == "parent").alias("in_parent"), F.max(F.col("relation") == "sister").alias("in_sister"))
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return runs.join(g, "run", "left").select(*runs.columns, no("in_parent"), no("in_sister"))
