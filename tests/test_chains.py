"""Greedy chains read in order and dealt by jumps, against a loop over every piece."""

import random

import pytest

from cladeloom.operators.runs import collinear_chains

PIECES = "locus bigint, taxon string, ix bigint, contig string, strand string, start bigint, end bigint, bases bigint"


def chains_of(pieces, max_span):
    out, state = {}, {}
    for locus, taxon, ix, contig, strand, start, end, _ in sorted(pieces):
        u, v = (-end, -start) if strand == "-" else (start, end)
        head, at, last = state.get((locus, taxon, contig, strand), (None, 0, 0))
        if head is None or u < last or v > at + max_span:
            head, at = ix, u
        state[locus, taxon, contig, strand] = (head, at, v)
        out[locus, taxon, ix, contig, strand] = head
    return out


@pytest.mark.parametrize("cut_from", [0, 40, 1000])
def test_chains_against_a_loop(spark, cut_from):
    rng = random.Random(11)
    pieces = []
    for locus, n in ((1, 3), (2, 60), (3, 120), (4, 1)):
        at = {}
        for ix in range(n):
            contig, strand = rng.choice("ab"), rng.choice("+-")
            a = at.get((contig, strand), 5000)
            a += rng.choice([20, 30, 60, -500]) * (-1 if strand == "-" else 1)
            at[contig, strand] = a
            pieces.append((locus, "t", ix, contig, strand, a, a + 15, 15))
    got = collinear_chains(spark.createDataFrame(pieces, PIECES), 200, cut_from).collect()
    assert {(r.locus, r.taxon, r.ix, r.contig, r.strand): r.chain for r in got} == chains_of(pieces, 200)
    assert len(got) == len(pieces)


def test_chains_of_small_groups_shuffle_their_pieces_once(spark):
    df = collinear_chains(spark.createDataFrame([(1, "t", 0, "a", "+", 5, 9, 4)], PIECES), 200)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
