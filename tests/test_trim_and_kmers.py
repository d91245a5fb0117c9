"""Trimming against a letter-by-letter version, and shared k-mers of very long and very common sequences."""

import random

from pyspark.sql import functions as F

from cladeloom.operators.align import trim_to_cds
from cladeloom.operators.similarity import kmer_join, shared_spans

ALN = "locus string, taxon string, text string, is_ref boolean"
EX = "locus string, starts_right int, lens array<bigint>, strand string"


def trim(spark, rows, exons, seqs, files=None):
    f = None if files is None else spark.createDataFrame(files, "locus string, preamble boolean")
    out, rep = trim_to_cds(spark.createDataFrame(rows, ALN), spark.createDataFrame(exons, EX), spark.createDataFrame(seqs, "locus string, cds string"), f)
    return {(r.locus, r.taxon): r.text for r in out.collect()}, {r.locus: r for r in rep.collect()}


def test_trimmed_columns_by_hand(spark):
    rnd = random.Random(5)
    rows, exons, seqs, want = [], [], [], {}
    for i in range(60):
        lens = [rnd.randint(1, 9) for _ in range(rnd.randint(1, 5))]
        minus, right = i % 2 == 1, rnd.randrange(len(lens))
        mode = i % 3 if len(lens) > 1 else (i % 3 if i % 3 != 2 else 1)
        cols, cds, drop = [], "", []  # a column is (reference letter, other letter, why it goes)
        for e, n in enumerate(lens):
            bases = [(rnd.choice("ACGTacgt"), rnd.choice("acGT-"), "") for _ in range(n)]
            cds += "".join(b[0] for b in bases).upper()
            if mode == 1 or (mode == 2 and e != right):
                bases.insert(0 if minus else n, (rnd.choice("ACGT"), rnd.choice("AC-"), "extra"))
            for b in bases:
                while rnd.random() < 0.2:
                    cols.append(("-", rnd.choice("AC-"), "gap"))
                cols.append(b)
        name = f"l{i}"
        rows += [(name, "ref", "".join(c[0] for c in cols), True), (name, "x", "".join(c[1] for c in cols), False)]
        exons.append((name, right, lens, "-" if minus else "+"))
        seqs += [(name, cds), (name, cds.lower())]
        drop = [k + 1 for k, c in enumerate(cols) if c[2] == "extra"]
        want[name] = ("".join(c[0] for c in cols if not c[2]), "".join(c[1] for c in cols if not c[2]), drop,
                      sum(c[2] == "gap" and c[1] != "-" for c in cols), sum(c[2] == "extra" and c[1] != "-" for c in cols))
    text, rep = trim(spark, rows, exons, seqs)
    for name, (ref, other, drop, gaps, extra) in want.items():
        r = rep[name]
        assert r.status == "OK", (name, r)
        assert (text[name, "ref"], text[name, "x"]) == (ref, other)
        assert (r.extra_columns, r.bases_in_gap_columns, r.bases_in_extra_columns) == (",".join(map(str, drop)), gaps, extra)


def test_statuses_of_trimming(spark):
    rows = [("amb", "r", "NCGTY", True), ("noanchor", "r", "NNGTA", True), ("shift", "r", "CGTT", True), ("shift-", "r", "TACG", True), ("diff", "r", "AAAA", True), ("null", "r", None, True), ("one", "r", "ACGT-", True)]
    exons = [("amb", 1, [2, 3], "+"), ("noanchor", 1, [2, 3], "+"), ("shift", 0, [4], "+"), ("shift-", 0, [4], "-"), ("diff", 0, [4], "+"), ("null", 0, [4], "+"), ("one", 0, [4], "+")]
    seqs = [("amb", "ACGTC"), ("noanchor", "ACGTA"), ("shift", "ACGT"), ("shift-", "ACGT"), ("diff", "ACGT"), ("null", "ACGT"), ("one", "ACGT")]
    _, rep = trim(spark, rows, exons, seqs, [(x[0], False) for x in exons])
    assert {k: r.status for k, r in rep.items()} == {
        "amb": "OK", "noanchor": "REFERENCE_MISMATCH_AFTER_TRIM", "shift": "EXTRACTION_SHIFTED", "shift-": "EXTRACTION_SHIFTED", "diff": "REFERENCE_MISMATCH_AFTER_TRIM",
        "null": "NO_RECORDS", "one": "OK"}
    assert rep["amb"].accepted == "1:N/A,5:Y/C" and rep["one"].bases_in_gap_columns == 0
    assert trim(spark, [], [], []) == ({}, {})


def test_kmers_by_hand(spark):
    rnd = random.Random(9)
    core = ["".join(rnd.choice("abc") for _ in range(rnd.randint(0, 40))) for _ in range(8)]
    t = {i: "".join(rnd.sample(core, 3)) for i in range(40)} | {90: None, 91: "", 92: "a" * 700}
    q = {i: rnd.choice(core) + rnd.choice(core) for i in range(12)} | {80: None, 81: "aaaa", 82: "aaaaaaaa"}
    k, share = 5, 0.6
    frame = lambda d: spark.createDataFrame(list(d.items()), "rep bigint, seq string")
    pairs = kmer_join(frame(q), frame(t), k, share)
    cut = lambda s: [s[i:i + k] for i in range(len(s or "") - k + 1)]
    want = {}
    for a, x in q.items():
        for b, y in t.items():
            kx, ky = set(cut(x)), set(cut(y))
            if kx and len(kx & ky) >= share * len(kx):
                cover = lambda s, other: len({j for i, g in enumerate(cut(s)) if g in other for j in range(i, i + k)}) * 100 / len(s)
                want[a, b] = (len(kx & ky), len(kx), round(cover(x, ky), 2), round(cover(y, kx), 2))
    got = {(r.query, r.target): (r.n_shared, r.n_query, r.query_pct, r.target_pct) for r in shared_spans(pairs, frame(q), frame(t), k).collect()}
    assert got.keys() == want.keys() and len(got) > 5
    assert all(got[p][:2] == want[p][:2] and all(abs(u - v) < 0.011 for u, v in zip(got[p][2:], want[p][2:])) for p in got)


def test_kmers_of_a_sequence_of_ten_million_letters(spark):
    letters = spark.range(10_000_000 // 8).select(F.lpad(F.hex(F.xxhash64("id")), 16, "0").substr(1, 8).alias("s"), "id")
    parts = [r.s for r in letters.orderBy("id").collect()]
    long = "".join(parts)
    probe = long[7_000_000:7_000_400]
    t = spark.createDataFrame([(1, long), (2, "zz" + long[:300])], "rep bigint, seq string")
    q = spark.createDataFrame([(5, probe), (6, long[65_400:65_700])], "rep bigint, seq string")
    got = {(r.query, r.target): r.n_shared for r in kmer_join(q, t, 12, 0.9).collect()}
    assert got == {(5, 1): 389, (6, 1): 289}
