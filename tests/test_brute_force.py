"""Operators without an SQL form, against independent plain-Python versions of their rule on random cases."""

import itertools
import random

from pyspark.sql import functions as F

from cladeloom.functions import aligned as A
from cladeloom.functions import ids as ids_f
from cladeloom.operators import evidence as E
from cladeloom.operators import graph as G
from cladeloom.operators import intervals as I
from cladeloom.operators import overlap as O
from cladeloom.operators import records as R
from cladeloom.operators import runs as W
from cladeloom.operators import tree as H

EDGES = [("N1", "N0"), ("D", "N0"), ("N2", "N1"), ("C", "N1"), ("A", "N2"), ("B", "N2"), ("N3", "N0"), ("E", "N3"), ("F", "N3")]
PARENT = dict(EDGES)
LEAVES = ["A", "B", "C", "D", "E", "F"]
INNER = ["N0", "N1", "N2", "N3"]


def toy_tree(spark):
    return H.tree_tables(spark.createDataFrame(EDGES, "node string, parent string"))


def below(n):
    out = {n}
    while True:
        more = {c for c, p in EDGES if p in out} - out
        if not more:
            return out
        out |= more


def test_parsimony_states(spark):
    rng = random.Random(1)
    tips = {u: {s: rng.choice([0, 1, None]) for s in LEAVES} for u in range(25)}
    rows = [(u, s, v) for u, t in tips.items() for s, v in t.items() if v is not None]
    got = {}
    asked = spark.createDataFrame([(u, n) for u in tips for n in LEAVES + INNER], "unit long, node string")
    for r in H.parsimony_states(spark.createDataFrame(rows, "unit long, species string, state int"), toy_tree(spark), asked).collect():
        got[(r.unit, r.node)] = {s for s, ok in ((0, r.can0), (1, r.can1)) if ok}
    nodes = LEAVES + INNER
    for u, t in tips.items():
        best, sets = None, {}
        free = [n for n in nodes if t.get(n) is None]
        for vals in itertools.product((0, 1), repeat=len(free)):
            st = {**{s: v for s, v in t.items() if v is not None}, **dict(zip(free, vals))}
            cost = sum(st[c] != st[p] for c, p in EDGES)
            if best is None or cost < best:
                best, sets = cost, {n: set() for n in nodes}
            if cost == best:
                for n in nodes:
                    sets[n].add(st[n])
        if any(v is not None for v in t.values()):
            for n in nodes:
                assert got[(u, n)] == sets[n], (u, n)


def test_dollo_with_unknown_leaves(spark):
    rng = random.Random(2)
    cases = {u: {s: rng.choice("pau") for s in LEAVES} for u in range(40)}
    t = toy_tree(spark)
    frame = lambda k: spark.createDataFrame([(u, s) for u, c in cases.items() for s, v in c.items() if v == k], "unit long, species string")
    units = spark.createDataFrame([(u, "N0") for u in cases], "unit long, origin string")
    got = {}
    for r in H.dollo_losses(units, frame("p"), t, frame("u")).collect():
        got.setdefault(r.unit, set()).add(r.branch)
    for u, c in cases.items():
        # fewest losses over all states of the unknown leaves; a loss sits as high as it can
        best = None
        unk = [s for s in LEAVES if c[s] == "u"]
        for vals in itertools.product((True, False), repeat=len(unk)):
            have = {s for s in LEAVES if c[s] == "p"} | {s for s, v in zip(unk, vals) if v}
            carry = {n for n in LEAVES + INNER if below(n) & have} | {"N0"}
            lost = {n for n, p in EDGES if p in carry and n not in carry}
            if best is None or len(lost) < best:
                best = len(lost)
        assert len(got.get(u, set())) == best, (u, c)


def test_collinear_chains(spark):
    rng = random.Random(3)
    rows, runs = [], {}
    for locus in range(30):
        for strand in "+-":
            pos, ex = (0 if strand == "+" else 2000), []
            for ix in range(rng.randint(1, 14)):
                step = rng.choice([5, 10, 40, 90, -30])
                pos = pos + step if strand == "+" else pos - step
                ex.append((ix, pos, pos + rng.randint(1, 8)))
            rows += [(locus, "t", ix, "c", strand, s, e, e - s) for ix, s, e in ex]
            runs[locus, strand] = ex
    df = spark.createDataFrame(rows, "locus long, taxon string, ix long, contig string, strand string, start long, end long, bases long")
    got = {(r.locus, r.strand, r.ix): r.chain for r in W.collinear_chains(df, 100).collect()}
    assert len(got) == len(rows)
    width = lambda pieces: max(e for _, _, e in pieces) - min(s for _, s, _ in pieces)
    for (locus, strand), ex in runs.items():
        onward = lambda a, b: b[1] >= a[2] if strand == "+" else b[2] <= a[1]  # noqa: E731, B023
        chains = [list(c) for _, c in itertools.groupby(ex, key=lambda x: got[locus, strand, x[0]])]  # noqa: B023
        assert sum(map(len, chains)) == len(ex) and len({got[locus, strand, c[0][0]] for c in chains}) == len(chains)
        for chain in chains:
            # named by its first piece, every step allowed, never too wide
            assert got[locus, strand, chain[0][0]] == chain[0][0]
            assert all(onward(a, b) for a, b in zip(chain, chain[1:])) and (len(chain) == 1 or width(chain) <= 100)
        for chain, following in zip(chains, chains[1:]):
            # every break was forced: the next piece turns back or makes the whole chain too wide
            assert not onward(chain[-1], following[0]) or width([*chain, following[0]]) > 100


def chain_rows(rows, jump):
    """The rule, block after block: highest total, the first of equals, links back from the first highest block."""
    out = set()
    for key in {r[:2] for r in rows}:
        best = None
        for group in {(r[3], r[4]) for r in rows if r[:2] == key}:
            b = sorted(r for r in rows if r[:2] == key and (r[3], r[4]) == group)
            total, back = [], []
            for r in b:
                options = [(total[j], -j) for j, q in enumerate(b[: len(total)]) if 0 <= r[5] - q[6] <= jump and total[j] > 0]
                top = max(options, default=(0, None))
                total.append(r[7] + top[0])
                back.append(None if top[1] is None else -top[1])
            at = total.index(max(total))
            rank, chain = (-total[at], b[0][2], group), []
            while at is not None:
                chain.append(b[at])
                at = back[at]
            best = min(best, (rank, chain)) if best else (rank, chain)
        out |= set(best[1])
    return out


def test_best_chain(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for exon in range(40):
        for ix in range(rng.randint(1, 9)):
            s = rng.randint(0, 120)
            rows.append((exon, "t", ix, rng.choice("xy"), rng.choice("+-"), s, s + rng.randint(1, 20), rng.randint(0, 9)))
    for ix in range(400):  # a dense group, in order, and one in any order
        rows.append((99, "t", ix, "x", "+", 3 * ix + rng.randint(0, 9), 3 * ix + rng.randint(10, 90), rng.randint(1, 4)))
        s = rng.randint(0, 4000)
        rows.append((99, "u", ix, "x", "+", s, s + rng.choice([1, 5, 700]), rng.randint(1, 4)))
    df = spark.createDataFrame(rows, "exon long, taxon string, block_ix long, contig string, strand string, start long, end long, bases long")
    want = chain_rows(rows, 25)
    assert {tuple(r) for r in W.best_chain(df, 25).collect()} == want
    assert {tuple(r) for r in W.best_chain(df, 25, cut_from=50).collect()} == want


def test_best_chain_sweep_in_pieces():
    rng = random.Random(8)
    for jump in (0, 25, 200):
        rows = sorted((s, s + rng.randint(1, 60), ix, rng.randint(0, 5)) for ix, s in enumerate(rng.randint(0, 2000) for _ in range(300)))
        whole, _ = W._sweep([], rows, jump)
        carried, cut = [], []
        for at in range(0, 300, 37):
            got, carried = W._sweep(carried, rows[at : at + 37], jump)
            cut += got
        assert cut == whole and len(carried) < 300


def test_best_chain_of_a_third_of_all_rows(spark):
    n = 150_000
    base = spark.range(3 * n)
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id"))
    start = F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(0).cast("long"))
    df = base.select(key.cast("long").alias("exon"), F.lit("t").alias("taxon"), F.col("id").alias("block_ix"), F.lit("x").alias("contig"), F.lit("+").alias("strand"),
                     start.alias("start"), (start + 3).alias("end"), F.lit(1).cast("long").alias("bases"))
    assert W.best_chain(df, 10).groupBy((F.col("exon") == 0).alias("hot")).count().collect()[0][1] > 0
    assert W.best_chain(df, 10).filter("exon = 0").count() == n


def test_intervals_on_a_hot_key(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 5)}", s, s + rng.choice([0, 1, 4, 300])) for s in (rng.randint(0, 900) for _ in range(700))]
    df = spark.createDataFrame(rows, "k string, s long, e long")
    cells = {}
    for k, s, e in rows:
        cells.setdefault(k, set()).update(range(s, e + 1))
    for width in (16, 4096):
        assert {r.k: r.n for r in I.union_length(df, ["k"], "s", "e", "n", width).collect()} == {k: len(v) for k, v in cells.items()}
        merged = {}
        for r in I.merge_intervals(df, ["k"], "s", "e", width=width).collect():
            merged.setdefault(r.k, []).append((r.s, r.e))
        for k, v in cells.items():
            m = sorted(merged[k])
            assert set().union(*[range(a, b + 1) for a, b in m]) == v
            assert all(b[0] > a[1] + 1 for a, b in zip(m, m[1:]))
    b = df.select("k", F.col("s").alias("s2"), F.col("e").alias("e2"))
    want = sum(1 for a in rows for c in rows if a[0] == c[0] and a[1] <= c[2] and c[1] <= a[2])
    assert I.overlap_join(df, b, ["k"], ("s", "e"), ("s2", "e2"), width=16, levels=2).count() == want


def test_connected_components(spark):
    rng = random.Random(6)
    e = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)]
    ids = sorted({x for p in e for x in p} | {999})
    label = {i: i for i in ids}
    for _ in ids:
        for a, b in e:
            label[a] = label[b] = min(label[a], label[b])
    got = G.connected_components(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(e, "src long, dst long"))
    assert {r.id: r.component for r in got.collect()} == label


def test_orf_measures(spark):
    ref, row = "ATGAAACCCGGGTTTTAA", "ATGAAACC-GGGTTTTAA"
    df = spark.createDataFrame([(ref, ref), (ref, row)], "r string, q string")
    same, shifted = A.orf_call(df, "r", "q", 50.0, 50.0, 50.0).orderBy(F.col("q").desc()).collect()
    assert same.has_orf and same.cov_pct == 100.0
    assert not shifted.has_orf and shifted.row_in_frame < 100.0
    for m in ("orf", "row"):
        x = A.orf_call(df, "r", "q", 80.0, 80.0, 80.0, measure=m).orderBy(F.col("q").desc()).collect()
        assert [r.has_orf for r in x] == [True, False]


def test_overlap_classes(spark):
    genes = [("own1", 100, 200, "+"), ("cds", 150, 260, "+"), ("own2", 1000, 1100, "+"), ("anti", 1050, 1200, "-"), ("own3", 3000, 3100, "+"), ("left", 2500, 2600, "+"), ("own4", 9000, 9100, "-")]
    g = spark.createDataFrame([(n, "Chr1", s, e, d) for n, s, e, d in genes], "gene string, chrom string, g_start long, g_end long, g_strand string")
    cds = g.select("gene", F.col("g_start").alias("c_start"), F.col("g_end").alias("c_end"))
    own = [x for x in genes if x[0].startswith("own")]
    loci = spark.createDataFrame([(n.replace("own", "L"), "chr1", s, e, d, "named", n) for n, s, e, d in own] + [("L9", "chr1", 1, 2, "+", "unmatched", None)],
                                 "locus string, chrom string, start long, end long, strand string, status string, own_gene string")
    got = {r.locus: (r.orientation, r.other_gene) for r in O.classify_overlap(loci, g, cds, loci.select(F.col("own_gene").alias("gene"))).collect()}
    assert got == {"L1": ("same_strand_cds_overlap", "cds"), "L2": ("antisense_overlap", "anti"), "L3": ("down_same", "left"), "L4": ("intergenic", None), "L9": ("own_gene_not_found", None)}


def rows_of(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_short_intervals_never_meet_on_coarse_levels(spark):
    """One key, short intervals far apart: the pairs that meet before spans are compared grow as the rows do."""

    def met(n):
        a = spark.range(n).selectExpr("1 AS k", "id * 5000 AS s", "id * 5000 + 9 AS e", "id AS i")
        b = spark.range(n).selectExpr("1 AS k", "id * 5000 + 5 AS bs", "id * 5000 + 14 AS be", "id AS j")
        span = ["k"], ("s", "e"), ("bs", "be")
        assert I.overlap_join(a, b, *span).count() == n
        return I.meetings(a, b, *span, I.WIDTH, 4, 16).count()

    few, many = met(1000), met(2000)
    assert many < 2.2 * few


def test_long_and_short_intervals_meet(spark):
    rng = random.Random(5)
    a = [(1, s := rng.randint(0, 10**6), s + rng.choice([0, 5, 300, 50_000, 900_000]), i) for i in range(80)]
    b = [(1, s := rng.randint(0, 10**6), s + rng.choice([0, 5, 300, 50_000, 900_000]), i) for i in range(80)]
    got = I.overlap_join(rows_of(spark, a, "k int, s long, e long, i int"), rows_of(spark, b, "k int, bs long, be long, j int"), ["k"], ("s", "e"), ("bs", "be"))
    want = sorted((x[3], y[3]) for x in a for y in b if x[1] <= y[2] and y[1] <= x[2])
    assert sorted((r["i"], r["j"]) for r in got.collect()) == want


def test_natural_key_beyond_any_width(spark):
    ids = ["c" + "9" * 20, "c1" + "0" * 24, "c2", "c10", "c010", "d", "c", "c1b10", "c1b9"]
    df = rows_of(spark, [(i,) for i in ids], "x string")
    got = [r["x"] for r in df.orderBy(ids_f.natural_key("x"), "x").collect()]
    assert got == ["c", "c1b9", "c1b10", "c2", "c010", "c10", "c" + "9" * 20, "c1" + "0" * 24, "d"]


def test_loose_ids_keep_numbers_apart(spark):
    rows = [("AT1G01010", "arabidopsis_thaliana"), ("AT1G01011", "arabidopsis_thaliana"), ("db|arabidopsis_AT1G01010.1|x", "arabidopsis_thaliana"), ("at1g01010.p1", None), ("g_12_3.t2", "s")]
    got = [r[0] for r in rows_of(spark, rows, "x string, sp string").select(ids_f.loose_id("x", "sp")).collect()]
    assert got[:3] == ["at1g01010", "at1g01011", "at1g01010"] and got[4] == "g.12.3"


def test_first_listed_line_wins_ties(spark):
    rows = [("g", "t", "A_b", 1e-9, 50.0, 95.0, 1, 90, 1, 90, 100, 100, 1), ("g", "t", "A_b", 1e-9, 50.0, 40.0, 1, 90, 1, 90, 100, 100, 2)]
    cols = "gene_id string, target string, target_species string, evalue double, bitscore double, pident double, qstart int, qend int, sstart int, send int, qlen int, slen int, line int"
    r = E.evaluate_hits(rows_of(spark, rows, cols), E.HitRules(min_pident=50.0)).first()
    assert r["pident"] == 95.0 and r["counts_as_hit"]
    r = E.evaluate_hits(rows_of(spark, rows, cols), E.HitRules(not_counted_taxa=("A",))).first()
    assert r["note"] == "own_clade:A" and r["in_phylogeny"]


def test_excluded_files_and_tags(spark):
    rows = [("Genus_one", "a", "MK"), ("Genus_two", "b__Genus_one", "MK"), ("Genus_two", "c__7x", "M*")]
    kept, table, bad = R.build_reference_set(rows_of(spark, rows, "file_species string, id string, seq string"), ["genus ONE"])
    assert sorted(r["id"] for r in kept.collect()) == ["b__Genus_one", "c__7x__Genus_two"]
    got = {r["file_species"]: (r["n_sequences"], r["n_tagged"], r["n_odd"], r["status"]) for r in table.collect()}
    assert got == {"Genus_one": (1, 0, 0, "EXCLUDED"), "Genus_two": (2, 1, 1, "INCLUDED")} and bad.isEmpty()
    one = rows_of(spark, [("a__b rest", "f")], "header string, file string")
    assert R.tag_ids(one, "header", "file", species="S p").first()["tagged_id"] == "a__b__S_p"
    assert R.tag_ids(one, "header", "file", species="S p", remove=True).first()["tagged_id"] == "a__S_p"


def test_cycles_are_found(spark):
    import pytest

    with pytest.raises(ValueError):
        H.tree_tables(rows_of(spark, [("a", "r"), ("b", "c"), ("c", "d"), ("d", "b")], "node string, parent string"))


def test_ancestors_by_preorder(spark):
    tree = toy_tree(spark)
    rng = random.Random(4)
    sets = {k: rng.sample(LEAVES + INNER, rng.randint(1, 4)) for k in range(40)}
    got = {r["k"]: r["lca"] for r in H.lca(rows_of(spark, [(k, n) for k, s in sets.items() for n in s], "k int, node string"), tree, "k").collect()}
    for k, s in sets.items():
        holds = [n for n in LEAVES + INNER if set(s) <= below(n)]
        assert got[k] == min(holds, key=lambda n: len(below(n)))
