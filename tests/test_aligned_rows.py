"""Start gains and ORF presence read from aligned rows, on rows made by hand."""

import pytest
from pyspark.errors import PySparkException

from cladeloom.operators.classify import orf_presence_from_rows, start_gains_from_rows, tip_states_from_rows
from cladeloom.operators.tree import tree_tables

ALN = "gene string, taxon string, ref_text string, row_text string"


def test_start_gains_from_rows(spark):
    rows = [
        ("a", "plain", "A-TGAAACCC", "C-TGAAACCC"), ("a", "gap_in_ref", "A-TGAAACCC", "GATGTAACCC"), ("a", "atg", "A-TGAAACCC", "A-TGAAACCC"), ("a", "gap", "A-TGAAACCC", "A--GAAACCC"),
        ("a", "n", "A-TGAAACCC", "N-TGAAACCC"), ("a", "known", "A-TGAAACCC", "C-TGAAACCC"), ("a", "later_atg", "A-TGAAACCC", "C-TGATGCCC"), ("b", "not_atg", "GTGAAACCC", "CTGAAACCC"),
        ("c", "short", "AT", "CT"), ("c", "empty", "", ""), ("c", None, "ATG", "CTG"), ("d", "null", None, "CTG"), ("d", "null_row", "ATG", None), ("e", "lower", "atg", "ctg"),
    ]
    known = spark.createDataFrame([("a", "known"), ("a", "known")], "gene string, taxon string")
    aln = spark.createDataFrame(rows, ALN)
    got = {(r.gene, r.taxon, r.codon) for r in start_gains_from_rows(aln, known, 70.0, 70.0).collect()}
    assert got == {("a", "plain", "noATG_CTG"), ("a", "gap_in_ref", "noATG_GTG"), ("a", "later_atg", "noATG_CTG"), ("c", None, "noATG_CTG"), ("e", "lower", "noATG_CTG")}
    # with a cut that the later ATG passes (six of nine bases), its row is no event
    assert "later_atg" not in {r.taxon for r in start_gains_from_rows(aln, known, 50.0, 50.0).collect()}
    assert start_gains_from_rows(aln.limit(0), known, 50.0, 50.0).count() == 0


def test_orf_presence_from_rows(spark):
    ref = "ATGAAACCCGGGAAA"
    rows = [("g", "orf", ref, ref), ("g", "none", ref, "CTGTAACCCTGAAAA"), ("g", "thin", ref, "--------CGGGNNA"), ("g", "two", ref, "---------------"), ("g", "two", ref, ref), ("g", "other", ref, ref), ("h", "null", ref, None)]
    cells = [("g", t, t == "focal") for t in ("focal", "orf", "none", "thin", "two", "absent")] + [("h", "null", False)]
    got = orf_presence_from_rows(spark.createDataFrame(cells, "gene string, taxon string, is_focal boolean"), spark.createDataFrame(rows, ALN), 80.0, 0.0, 80.0)
    assert {(r.gene, r.taxon): r.presence for r in got.collect()} == {
        ("g", "focal"): "1", ("g", "orf"): "1", ("g", "none"): "0", ("g", "thin"): "unknown", ("g", "two"): "1", ("g", "absent"): "unknown", ("h", "null"): "unknown"}


def test_tip_states_from_rows(spark):
    # f, a | b, c | d below p, q and the root
    tree = tree_tables(spark.createDataFrame([("f", "p"), ("a", "p"), ("p", "q"), ("b", "q"), ("c", "q"), ("q", "r"), ("d", "r"), ("r", None)], "node string, parent string"))
    species = spark.createDataFrame([(s,) for s in "fabcd"], "species string")
    events = spark.createDataFrame([("u1", "g", "f", "indel", 3, 0), ("u2", "g", "f", "stop", 6, 1)], "unit string, gene string, focal string, kind string, pos int, orf_ix int")
    carriers = [("g", "indel", 3, "p", 2), ("g", "indel", 3, "q", 5), ("g", "indel", 3, "a", 2), ("g", "indel", 3, "b", 5), ("g", "stop", 6, "q", 3), ("g", "stop", 6, "f", 3), ("g", "stop", 6, "d", 3), ("g", "stop", 7, "c", 3)]
    cols = "gene string, kind string, pos int, taxon string, length int"
    ref = "AC-GTACGT"
    # sites: letters 3 and 4 (G, T), letters 6 to 8 (C, G, T)
    rows = [("g", "a", ref, ref), ("g", "b", ref, "--AGT---T"), ("g", "c", ref, "ACA-TACGT"), ("g", "d", ref, "ACAGNACGT"), ("g", "p", ref, ref), ("g", "f", ref, ref), ("g", "b", ref, None)]
    got = tip_states_from_rows(events, spark.createDataFrame(carriers, cols), spark.createDataFrame(rows, ALN), species, tree)
    assert {(r.unit, r.species): r.state for r in got.collect()} == {
        ("u1", "f"): 0, ("u1", "a"): 1, ("u1", "b"): 0, ("u2", "f"): 0, ("u2", "a"): 0, ("u2", "c"): 0, ("u2", "d"): 1}
    with pytest.raises(PySparkException):
        tip_states_from_rows(events, spark.createDataFrame(carriers[:4], cols), spark.createDataFrame(rows, ALN), species, tree).collect()
