"""Overlap classes: loci and genes are got once, and the other gene is the one that starts first."""

from cladeloom.operators import overlap
from cladeloom.operators.overlap import classify_overlap

LOCI = "locus string, chrom string, start bigint, end bigint, strand string, status string, own_gene string"


def classes(spark):
    loci = spark.createDataFrame([("a", "C", 10, 20, "+", "named", "ga"), ("b", "c", 30, 40, "-", "named", "gb"), ("d", "c", 90, 95, "+", "named", "gd"), ("u", "c", 1, 2, "+", "unmatched", None)], LOCI)
    genes = spark.createDataFrame([("ga", "c", 10, 20, "+"), ("g1", "c", 5, 60, "+"), ("g2", "c", 4, 12, "+"), ("g3", "c", 30, 35, "+")], "gene string, chrom string, g_start bigint, g_end bigint, g_strand string")
    cds = spark.createDataFrame([("ga", 12, 18), ("g1", 13, 14), ("g1", 15, 16), ("g2", 4, 12), ("g3", 30, 31)], "gene string, c_start bigint, c_end bigint")
    return classify_overlap(loci, genes, cds, spark.createDataFrame([("ga",), ("ga",)], "gene string"), 30)


def test_other_gene_of_each_class(spark):
    assert {tuple(r) for r in classes(spark).select("locus", "orientation", "other_gene").collect()} == {
        ("a", "same_strand_cds_overlap", "g2"), ("b", "antisense_overlap", "g1"), ("d", "down_same", "g1"), ("u", "own_gene_not_found", None)}


def test_inputs_are_read_once(spark):
    plan = classes(spark).filter("locus <> 'u'")._jdf.queryExecution().executedPlan().toString()
    # the loci without a name come straight from the input
    assert plan.count("Scan ExistingRDD") <= 1 and "FileScan parquet" in plan


def test_only_undecided_loci_are_looked_up_further(spark, monkeypatch):
    asked = []
    for name in ("first_overlap_join", "nearest_join"):
        step = getattr(overlap, name)
        monkeypatch.setattr(overlap, name, lambda a, *args, _step=step: (asked.append(sorted(r[0] for r in a.select("locus").collect())), _step(a, *args))[1])
    classes(spark)
    assert asked == [["b", "d"], ["b", "d"], ["d"]]
