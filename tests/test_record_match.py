"""Records to proteins: every rule, its ambiguity, and the choice among records."""

from cladeloom.operators import record_match as R
from cladeloom.plans import match_queries as Q

FEATURES = [
    (1, "gene", None, None, {"ID": "g1", "Name": "N1", "gene": "G1", "Dbxref": "x,GeneID:77"}),
    (2, "mRNA", None, None, {"ID": "rna-t1", "Parent": "g1", "locus_tag": "L1"}),
    (3, "CDS", None, None, {"Parent": "rna-t1", "protein_id": "old"}),
    (4, "CDS", None, None, {"Parent": "rna-t1", "protein_id": "P1"}),
    (5, "exon", 10, 20, {"Parent": "rna-t1"}),
    (6, "exon", 30, 40, {"Parent": "rna-t1"}),
    (7, "gene", None, None, {"ID": "g2", "Name": "N2", "gene": "shared"}),
    (8, "transcript", None, None, {"ID": "t2", "Parent": "g2"}),
    (9, "transcript", None, None, {"ID": "t3", "Parent": "g2"}),
    (10, "CDS", None, None, {"Parent": "t2,t9", "protein_id": "P2"}),
    (11, "CDS", None, None, {"Parent": "t3", "protein_id": "P3.p"}),
    (12, "exon", 5, 9, {"Parent": "t2"}),
    (13, "exon", 5, 9, {"Parent": "t3"}),
    (14, "gene", None, None, {"ID": "g4", "gene": "t3"}),
    (15, "mRNA", None, None, {"ID": "t4", "Parent": "g4"}),
    (16, "CDS", None, None, {"Parent": "t4", "protein_id": "Q4.1"}),
]
WANT = {
    "a [protein_id=P1] polypeptide=P2 ": ("P1", "ExplicitID"),
    "b polypeptide=P2 [transcript_id=t1]": ("P2", "ExplicitID"),
    "c [protein_id=none] [location=join(30..>40,<10..20)]": ("P1", "Fingerprint"),
    "d [location=5..9]": (None, None),  # two proteins have these exons
    "e [transcript_id=t1]": ("P1", "TransMap"),
    "f [transcript_id=t3]": ("Q4.1", "TransMap"),  # the tag of a gene beats a transcript of that name
    "g [locus_tag=L1]": ("P1", "LocusMap"),
    "h [gene=shared]": (None, None),
    "i [gene=G1] [location=5..9]": ("P1", "GeneMap"),
    "j db_xref=GeneID:77": ("P1", "GeneIDMap"),
    "P2 text": ("P2", "SimpleID"),
    "P3 text": ("P3.p", "SimpleID_p"),
    "lcl|c_cds_Q4.1_7": ("Q4.1", "LCLFallback"),
    "k [protein_id=old]": (None, None),  # no listed protein
    "": (None, None),
}


def test_every_rule(spark):
    feats = spark.createDataFrame(FEATURES, "row long, type string, start long, end long, attrs map<string,string>")
    prots = spark.createDataFrame([(p, p, 9) for p in ("P1", "P2", "P3.p", "Q4.1", "lost")], "protein string, header string, length int")
    recs = spark.createDataFrame([(i, h, 5) for i, h in enumerate(WANT)], "row long, header string, length int")
    m = R.match_records(recs, feats, prots)
    assert {r.header: (r.protein, r.rule) for r in m.collect()} == WANT
    assert [(r.protein, r.gene) for r in R.missing_proteins(prots, m).collect()] == [("lost", "NA")]


def test_choice_among_records(spark):
    rows = [(1, "x XR_1", 90), (2, "x", 50), (3, "x gbkey=mRNA", 20), (4, "y NM_1", 20), (5, "x gbkey=mRNA", 20), (6, "x XM_1", 30)]
    m = spark.createDataFrame([(*r, "P", "SimpleID") for r in rows[:5]] + [(*rows[5], None, None)], "row long, header string, length int, protein string, rule string")
    assert [tuple(r) for r in R.best_records(m).collect()] == [("P", 3, "x gbkey=mRNA", 20, "SimpleID", 5)]
    assert sorted(r.header for r in R.headers_not_kept(m).collect()) == ["x", "x XR_1", "y NM_1"]


def test_all_rules_occur_in_the_query(spark):
    rules = {r.rule for r in Q.match_records(spark, "/root/testdata/sf0.01").select("rule").distinct().collect()}
    assert rules == {None, *R.RULES}
