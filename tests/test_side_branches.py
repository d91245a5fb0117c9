"""Side branches, gene strata and inferred nodes against small versions by sets."""

import random

from cladeloom.operators.classify import inferred_nodes, with_inferred
from cladeloom.operators.tree import gene_strata, side_branch_counts, side_branches, stratum_counts, tree_tables


def small_tree(spark, seed):
    rnd = random.Random(seed)
    parent = {0: None}
    for n in range(1, 30):
        parent[n] = rnd.randrange(n)
    edges = spark.createDataFrame(list(parent.items()), "node bigint, parent bigint")
    kids = {n: [k for k, p in parent.items() if p == n] for n in parent}
    leaves = {n for n in parent if not kids[n]}
    clade = lambda n: ({n} if n in leaves else set()) | {x for k in kids[n] for x in clade(k)}
    return rnd, parent, leaves, clade, tree_tables(edges)


def test_side_branches_and_counts(spark):
    rnd, parent, leaves, clade, tree = small_tree(spark, 3)
    got = {(r.node, r.child): r for r in side_branches(tree).collect()}
    want = {(p, c): clade(p) - clade(c) for c, p in parent.items() if p is not None}
    assert {k: r.n_species for k, r in got.items()} == {k: len(v) for k, v in want.items()}
    assert all(r.lo <= r.skip_lo <= r.skip_hi <= r.hi for r in got.values())
    lines = [rnd.choice(sorted(leaves)) for _ in range(200)] + [None, 999]
    counts = {(r.node, r.child): r.n_lines for r in side_branch_counts(spark.createDataFrame([(x,) for x in lines], "species bigint"), tree).collect()}
    assert counts == {k: sum(x in v for x in lines) for k, v in want.items()}


def test_gene_strata(spark):
    rnd, parent, leaves, clade, tree = small_tree(spark, 4)
    pool = sorted(leaves) + [777]  # one species is not in the tree
    members = [(rnd.randrange(30), rnd.choice(pool), rnd.randrange(25)) for _ in range(90)]
    proteins = [(s, g) for s in pool for g in range(25)]
    m, p = spark.createDataFrame(members, "group bigint, species bigint, gene bigint"), spark.createDataFrame(proteins, "species bigint, gene bigint")
    up = lambda n: [n] + (up(parent[n]) if parent[n] is not None else [])
    want = set()
    for g, s, x in set(members):
        every = {b for a, b, _ in members if a == g}
        known = every & leaves
        if s not in leaves:
            continue
        if len(every) == 1:
            want.add((s, x, "species_specific_clustered", g))
        elif len(known) > 1:
            want.add((s, x, str(next(n for n in up(s) if known <= clade(n))), g))
    held = {w[:2] for w in want}
    want |= {(s, x, "species_specific_unclustered", None) for s, x in proteins if s in leaves and (s, x) not in held}
    strata = gene_strata(m, p, tree)
    assert {tuple(r) for r in strata.select("species", "gene", "stratum", "group").collect()} == want
    none = {r.species: r for r in stratum_counts(strata).filter("stratum = 'species_specific_unclustered'").collect()}
    assert all(r.n_groups is None for r in none.values())
    assert gene_strata(m.limit(0), p.limit(0), tree).count() == 0


def test_inferred_nodes(spark):
    chosen = spark.createDataFrame([("g", "stop", 7, 1, [5, 6, 0]), ("h", "stop", 7, 1, [2])], "gene string, kind string, event bigint, orf_ix bigint, ixs array<bigint>")
    node = "gene string, kind string, event bigint, ix bigint, length bigint"
    at = spark.createDataFrame([("g", "stop", 7, 6, 3), ("g", "stop", 7, 6, 4), ("g", "stop", 7, 0, 9)], node)
    side = [("g", "stop", 7, ix, n) for ix, n in [(1, 3), (2, 3), (2, 4), (3, 9), (4, 4), (5, 3)]] + [("g", "indel", 7, 3, 3), ("h", "stop", 7, 2, 3)]
    bears = spark.createDataFrame([("g", 4), ("g", 4), ("h", 2)], "gene string, ix bigint")
    inf = inferred_nodes(chosen, at, spark.createDataFrame(side, node), bears)
    assert sorted(map(tuple, inf.collect())) == [("g", "stop", 7, 2, "added"), ("g", "stop", 7, 4, "rejected")]
    assert {r.gene: r.ixs for r in with_inferred(chosen, inf).collect()} == {"g": [5, 6, 0, 2], "h": [2]}
