"""Search outputs are trusted only with proof that the search finished."""

import random

import pytest

from cladeloom.sources import files as S


def test_hits_need_a_matching_footer(spark, tmp_path):
    hit = "\t".join(["q1", "t", "99.0", "10", "0", "0", "1", "10", "1", "10", "6.1e-110", "50", "20", "30"])
    (tmp_path / "a.tsv").write_text(f"# BLASTP 2.17.0+\n# Query: q1\n{hit}\n# Query: q2\n# BLAST processed 2 queries\n# Query: q3\n")
    (tmp_path / "b.tsv").write_text("# Query: q4\n# BLAST processed 3 queries\n")
    hits, q = S.read_hits_tabular(spark, str(tmp_path))
    assert {r["query"]: r.confirmed for r in q.collect()} == {"q1": True, "q2": True, "q3": False, "q4": False}
    r = hits.collect()
    assert len(r) == 1 and r[0].evalue == 6.1e-110 and r[0].qend == 10
    # one good group confirms a query, whatever its others say
    (tmp_path / "c.tsv").write_text("# BLASTP 2.17.0+\n# Query: q5\n# BLAST processed 1 queries\n# Query: q5\n# BLAST processed 9 queries\n")
    assert {r["query"]: r.confirmed for r in S.read_hits_tabular(spark, str(tmp_path / "c.tsv"))[1].collect()} == {"q5": True}
    (tmp_path / "d.tsv").write_text(f"# Query: q6\n{hit}\n# BLAST processed 1 queries\n")
    with pytest.raises(Exception, match="no program header"):
        S.read_hits_tabular(spark, str(tmp_path / "d.tsv"))[0].collect()


def test_domain_table_needs_its_last_line(spark, tmp_path):
    line = " ".join(["t1", "-", "100", "q1", "-", "50", "1e-5", "40.0", "0.1", "1", "1", "1e-6", "1e-6", "39", "0.1", "3", "20", "5", "25", "1", "2", "0.9", "a title"])
    (tmp_path / "ok.domtbl").write_text(f"# head\n{line}\n# [ok]\n")
    (tmp_path / "cut.domtbl").write_text(line.replace("q1", "q2") + "\n")
    d, q = S.read_domtbl(spark, str(tmp_path))
    assert {r["query"]: r.confirmed for r in q.collect()} == {"q1": True, "q2": False}
    assert d.filter("query = 'q1'").first().send == 25


def test_pairs_and_matches(spark, tmp_path):
    p = tmp_path / "p"
    p.mkdir()
    (p / "A__v__B.tsv").write_text("Orthogroup\tA\tB\nOG1\ta1, a2\tb1\n")
    assert {(r.species, r.gene, r.other_species, r.other_gene) for r in S.read_pairs(spark, str(p)).collect()} == {("A", "a1", "B", "b1"), ("A", "a2", "B", "b1")}
    m, e = tmp_path / "m", tmp_path / "e"
    m.mkdir(), e.mkdir()
    row = "\t".join(["g1", "x", "100", "Pfam", "PF1", "d", "1", "50", "1e-9", "T", "d", "-", "-", "-", "-"])
    (m / "one.tsv").write_text(row + "\n")
    (m / "two.tsv").write_text(row + "\n")
    (e / "one.log").write_text("50% done\n100% done\n")
    got = S.read_domain_matches(spark, str(m), str(e))
    assert {r.file: r.finished for r in got.collect()} == {"one": True, "two": False}


@pytest.mark.parametrize("block", [64, 300, 10_000_000])
def test_footers_across_blocks(spark, tmp_path, block):
    """Files of several runs, read in blocks of a few lines: the same answer as one pass over the lines."""
    rng = random.Random(block)
    want, n = {}, 0
    for f in range(6):
        lines, pending = ["# BLASTP 2.17.0+"], []
        for _ in range(rng.randint(1, 40)):
            for _ in range(rng.choice([0, 1, 2, 9])):
                q = f"q{rng.randint(0, 60)}" if rng.random() < 0.2 else f"n{n}"
                n += 1
                pending.append(q)
                lines += [f"# Query: {q}"] + ["\t".join([q, "t", "99.0", "10", "0", "0", "1", "10", "1", "10", "1e-9", "50", "20", "30"])] * rng.choice([0, 0, 3])
            if rng.random() < 0.7:
                said = len(pending) + (rng.random() < 0.3)
                lines += [f"# BLAST processed {said} queries", ""]
                for q in pending:
                    want[q] = want.get(q, False) or said == len(pending)
                pending = []
        for q in pending:
            want.setdefault(q, False)
        (tmp_path / f"{f}.tsv").write_bytes("\r\n".join(lines).encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        hits, q = S.read_hits_tabular(spark, str(tmp_path))
        assert {r["query"]: r.confirmed for r in q.collect()} == want
        assert block > 1000 or hits.rdd.getNumPartitions() > 20
        (tmp_path / "d").mkdir()
        (tmp_path / "d" / "x.domtbl").write_text("# head\n" + "t1 - 100 q1 - 50 1e-5 40 0.1 1 1 1e-6 1e-6 39 0.1 3 20 5 25 1 2 0.9 a title\n" * 30 + "# [ok]\n\n\n")
        (tmp_path / "d" / "y.domtbl").write_text("# [ok]\n" + "t1 - 100 q2 - 50 1e-5 40 0.1 1 1 1e-6 1e-6 39 0.1 3 20 5 25 1 2 0.9 a title\n" * 30)
        assert {r["query"]: r.confirmed for r in S.read_domtbl(spark, str(tmp_path / "d"))[1].collect()} == {"q1": True, "q2": False}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
