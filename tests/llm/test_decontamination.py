import random
import re
from collections import Counter

import numpy as np

from cladeloom.llm import decontamination as d


def words_of(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())


def grams(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def by_hand(rows, items):
    out = []
    for doc, text in rows:
        w = words_of(text)
        for item, t in items:
            v = words_of(t)
            if not v or not w or item is None:
                continue
            k = min(5, len(v))
            best = 0.0
            for s in range(max(1, len(w) - len(v) + 1)):
                a, b = grams(w[s : s + len(v)], k), grams(v, k)
                if a:
                    best = max(best, (a & b).total() / (a | b).total())
            if best >= 0.8:
                out.append((str(doc), item, round(best, 9)))
    return sorted(out)


def test_matches_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["w%d" % i for i in range(80)] + ["É", "ßa", "你好"]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([1, 3, 5, 8, 20, 40, 60, 60, 90])]
    items += [(20, items[6][1].upper()), (21, None), (None, "w1 w2"), (22, "..."), (23, "")]
    rows = [(None, items[4][1]), (1, None), (1, ""), (2, "!?"), (3, items[5][1]), (3, items[5][1])]
    for i in range(60):
        own = rng.choice(items[:9])[1].split()
        if i % 3:
            for _ in range(i % 5):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
        if i % 7 == 0:
            own = own[: int(len(own) * 0.9)]
        rows.append((100 + i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)) + own + rng.choices(vocabulary, k=5))))
    rows.append((999, " ".join(rng.choices(vocabulary, k=40_000) + [items[8][1]])))
    docs = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, item_id string, found int")
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, start int")
    got = sorted((str(r["doc_id"]), r["item_id"], round(r["similarity"], 9)) for r in d.contaminated(docs, bench).collect())
    # one-word and three-word items are single shingles
    assert got == by_hand(rows, items)
    kept = d.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not by_hand([r], items) for r in rows)
    assert d.contaminated(docs.limit(0), bench).count() == 0
    assert d.decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(7)
    codes = rng.integers(0, 2**63, 300, dtype=np.uint64)
    index = d.HammingIndex(codes, 19)
    for c in codes[:40]:
        for n in (0, 5, 19, 20):
            x = c
            for b in rng.choice(64, n, replace=False):
                x ^= np.uint64(1) << np.uint64(b)
            want = [(i, int(v)) for i, v in enumerate(np.bitwise_count(codes ^ x)) if v <= 19]
            assert index.near(x) == want


def test_passes_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(d, "ITEMS_AT_ONCE", 2)
    items = [(i, f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(5)]
    docs = spark.createDataFrame([(1, "x " + items[0][1] + " y " + items[4][1]), (2, "x")], "doc_id long, text string")
    got = d.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 0), (1, 4)]
