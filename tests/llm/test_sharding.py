"""Sharding: the law of equal bytes, groups, slots, and the heap against plain scheduling."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from cladeloom.llm import sharding as S

SCHEMA = "doc_id long, text string, grp string, size long, bucket long, shard int, slot long, part long, n long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7, 7, 7, 7, 7, 7) for r in rows], SCHEMA)


def made(seed, n):
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choices("abc é", k=int(rng.paretovariate(1.1) * 20) % 5000))) for i in range(n)]
    rows += [(10_000 + i, "the same text") for i in range(n // 2)]  # a group of a third of all rows
    rows += [(20_000, None), (20_001, ""), (None, "no id"), (3, rows[3][1]), (3, rows[3][1]), (20_002, "x" * 30_000)]
    return rows


@pytest.mark.parametrize("per_bucket", [100_000, 40])
def test_law_of_bytes(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(S, "GROUPS_PER_BUCKET", per_bucket)
    rows = made(1, 1500)
    out = S.shard_documents(table(spark, rows), 6)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = out.collect()
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    assert {r.law for r in got} == {"bytes"} and all(r.grown_shard is None for r in got)
    slots, load, homes = defaultdict(list), Counter(), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
        homes[r.text_crc32].add(r.shard)
    assert set(slots) <= set(range(6)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())
    # no law can split the group; the other shards share what is left almost equally
    ranked = sorted(load[s] for s in range(6))
    assert ranked[-1] - ranked[0] <= max(30_008, 0.02 * sum(ranked))
    again = {(r.doc_id, r.text_crc32, r.shard) for r in S.shard_documents(table(spark, rows).repartition(7), 6).collect()}
    assert again == {(r.doc_id, r.text_crc32, r.shard) for r in got}


def test_longest_first_is_the_plain_schedule():
    rng = random.Random(2)
    for _ in range(30):
        sizes = [rng.randint(1, 50) for _ in range(rng.randint(0, 40))]
        loads = [rng.randint(0, 20) for _ in range(5)]
        want, now = [0] * len(sizes), list(loads)
        for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
            i = min(range(5), key=lambda i: (now[i], i))
            want[k], now[i] = i, now[i] + sizes[k]
        assert S.longest_first(sizes, loads) == want


def test_few_rows_and_empty_table(spark):
    assert S.shard_documents(table(spark, []), 24).collect() == []
    got = S.shard_documents(table(spark, [(1, "a"), (2, "a"), (3, None)]), 24).collect()
    of = {r.doc_id: (r.shard, r.slot) for r in got}
    assert of[1][0] == of[2][0] != of[3][0] and {of[1][1], of[2][1]} == {0, 1} and of[3][1] == 0
