import numpy as np
import pytest

from cladeloom.llm import embedding_dedup as e


def by_hand(rows, cosine):
    n = len(rows)
    ok = [i is not None and lab is not None and v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and any(v) for i, v, lab in rows]
    root, links = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(n):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                u, v = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) >= cosine:
                    links[a] += 1
                    links[b] += 1
                    root[max(find(a), find(b))] = min(find(a), find(b))
    out = []
    for a in range(n):
        same = [rows[b][0] for b in range(n) if find(b) == find(a)]
        low = rows[a][0] if not ok[a] else min(same)
        out.append((str(rows[a][0]), links[a], str(low), rows[a][0] is None or rows[a][0] == low))
    return sorted(out)


@pytest.mark.parametrize("group", [4000, 12])
def test_equals_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(e, "GROUP", group)
    rng = np.random.default_rng(6)
    f = lambda v: [float(np.float32(x)) for x in v]
    centre = rng.normal(size=(6, 20))
    rows = [(i, f(centre[i % 6] + rng.normal(size=20) * (0.05 + 0.4 * (i % 3))), i % 2) for i in range(90)]
    rows += [(200 + i, f(centre[0] * (i + 1)), 0) for i in range(15)] + [(300, rows[0][1], 0), (300, rows[0][1], 0), (301, rows[0][1], None)]
    rows += [(400, None, 0), (401, [], 0), (402, [0.0] * 20, 0), (403, [float("nan")] * 20, 0), (404, [None] + [1.0] * 19, 0), (405, [float("inf")] + [1.0] * 19, 0)]
    rows += [(None, rows[0][1], 0), (406, rows[0][1][:7], 0), (407, rows[0][1][:7], 0), (408, [-x for x in rows[0][1]], 0), (409, [1.0], 1), (410, [2.0], 1)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<float>, label int, node int")
    got = sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in e.near_duplicates(df).collect())
    assert got == by_hand(rows, 0.93)


def test_empty_table(spark):
    assert e.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_rows_travel_once_for_every_piece_of_their_label(spark, monkeypatch):
    # vectors that lie so close that no dimension tells them apart: the rows dealt to tasks must follow from the pieces alone
    monkeypatch.setattr(e, "GROUP", 50)
    monkeypatch.setattr(e, "_links", lambda cosine: lambda batches: (b.select(["node", "n", "n"]).rename_columns(["node", "root", "links"]) for b in batches))
    rng = np.random.default_rng(3)
    v = rng.normal(size=16) + rng.normal(size=(100, 16)) * 0.01
    unit = [(i, "a" if i < 90 else "b", 1, (x / np.sqrt(x @ x)).tobytes()) for i, x in enumerate(v)]
    met = e.links(spark.createDataFrame(unit, "node long, label string, n long, vec binary")).groupBy("node").count().collect()
    assert {(r[0] < 90, r[1]) for r in met} == {(True, 2), (False, 1)}
