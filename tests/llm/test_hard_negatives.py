"""Hard negatives against plain Python integers, and the residue products by themselves."""

import random

import numpy as np
import pytest

from cladeloom.llm import hard_negatives as N

SCHEMA = "vec_id long, embedding array<double>, label int, x int, rank string, rows string"


def by_hand(rows, every=100):
    whole = {}
    for i, e, label in rows:
        if i is None or label is None or e is None or any(c is None or c != c or abs(c) == float("inf") for c in e):
            continue
        whole[i] = ((label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * c)) for c in e])
    out = set()
    for a, (label, x) in whole.items():
        if a % every:
            continue
        scores = sorted((-sum(p * q for p, q in zip(x, y)), i) for i, (_, y) in whole.items() if i != a)
        positives = [(i, -s) for s, i in scores if whole[i][0] == label][:5]
        for p, ps in positives:
            hard = [(i, -s) for s, i in scores if whole[i][0] != label and 30 * ps <= -100 * s <= 90 * ps][:10]
            out |= {(a, p, rank, i, ps, s) for rank, (i, s) in enumerate(hard, 1)}
    return out


@pytest.mark.parametrize("rows_at_once", [8192, 40])
def test_against_integers(spark, monkeypatch, rows_at_once):
    monkeypatch.setattr(N, "ROWS", rows_at_once)
    monkeypatch.setattr(N, "ANCHORS", rows_at_once // 20)
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) + 0.4 for _ in range(6)], rng.randrange(10)) for i in range(0, 3000, 5)]
    rows += [(10_000 + i, [0.5] * 6, 3) for i in range(150)]  # ties among copies, anchors among them
    rows += [(20_000, None, 1), (20_100, [0.1] * 6, None), (20_200, [0.1, None] + [0.2] * 4, 1), (20_300, [float("nan")] + [0.2] * 5, 1)]
    rows += [(20_400, [float("inf")] + [0.2] * 5, 1), (None, [0.3] * 6, 1), (20_500, [0.0] * 6, 1), (20_600, [-0.001] * 6, 1)]
    table = [(i, e, g, 1, "clash", "clash") for i, e, g in rows]
    df = spark.createDataFrame(table + table[:50], SCHEMA).repartition(4)  # repeated rows
    out = N.hard_negatives(df)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = [tuple(r) for r in out.collect()]
    want = by_hand(rows)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500


def test_products_are_exact():
    rng = np.random.default_rng(2)
    for d, size in ((64, 2**8), (3000, 2**15), (5, 2**24), (1, 2**27), (0, 1)):
        a, b = (np.floor(rng.uniform(-size, size, (7, d))) for _ in range(2))
        bound = max(1, d) * size * size
        want = [[sum(int(p) * int(q) for p, q in zip(x, y)) for y in b] for x in a]
        assert N.exact_products(a, b, bound).tolist() == want
        for p in N.primes(min(N.WIDTH, max(1, d)), bound):
            assert min(N.WIDTH, max(1, d)) * (p // 2) ** 2 < 2**24 and np.abs(N.residues(a, p)).max(initial=0) <= p // 2
    extreme = np.array([[2.0**27, -(2.0**27)]])
    assert N.exact_products(extreme, extreme, 2**55).tolist() == [[2**55]] and N.exact_products(extreme, -extreme, 2**55).tolist() == [[-(2**55)]]


def test_empty_and_odd_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert N.hard_negatives(empty).collect() == []
    one = spark.createDataFrame([(100, [0.5, 0.5], 1)], "vec_id long, embedding array<float>, label int")
    assert N.hard_negatives(one).collect() == []
    mixed = spark.createDataFrame([(100, [0.5, 0.5], 1), (101, [0.5, 0.5], 1), (102, [0.25, 0.25], 2), (103, [0.9], 2), (104, [], 2)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in N.hard_negatives(mixed).collect()] == [(100, 101, 1, 102, 32768, 16384)]
    huge = spark.createDataFrame([(100, [1e30], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError):
        N.hard_negatives(huge)


def test_blocks_meet_without_a_broadcast(spark):
    # anchors that are exploded to all blocks grow with the square of the rows: they must not pass the driver
    rows = [(i, [0.1 * (i % 7), 0.5, 0.3], i % 3, 1, "", "") for i in range(300)]
    out = N.hard_negatives(spark.createDataFrame(rows, SCHEMA))
    assert out.count() > 0
    assert "BroadcastExchange" not in out._jdf.queryExecution().toString()
