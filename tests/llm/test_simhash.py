import numpy as np
import pyarrow as pa
import xxhash

from cladeloom.llm import simhash


def by_hand(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in low).split(" ") if w]
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components_by_hand(rows, radius=2):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(least[r], d)
    return [least[find(i)] for i in range(len(rows))]


def test_components_match_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = [None, "", " \t", "one", "One", "a b", "ÀB c d", "x y z"] + [" ".join(rng.choice(list("abcdefgh"), 9)) for _ in range(60)]
    texts += [t + " q" for t in texts[20:40]] + ["w" * 9 + " " + "long text " * 20_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "zz"), (5, "a b")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, u long")
    got = simhash.simhash_components(df).collect()
    fps = [(d, by_hand(t)) for d, t in rows]
    want = sorted((str(d), f"{fp:016x}", str(c)) for (d, fp), c in zip(fps, components_by_hand(fps), strict=True))
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == want
    assert simhash.simhash_components(df.limit(0)).count() == 0


def test_gray_index_finds_all_pairs():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2**63, 20, dtype=np.uint64)
    codes = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for c in centre]))
    group = rng.integers(0, 3, len(codes))
    index = simhash.GrayIndex(group, codes)
    got = {tuple(sorted((int(index.order[a]), int(index.order[b])))) for i, j in index.pairs(2) for a, b in zip(i, j, strict=True)}
    want = {
        (a, b)
        for a in range(len(codes))
        for b in range(a + 1, len(codes))
        if group[a] == group[b] and bin(int(codes[a] ^ codes[b])).count("1") <= 2
    }
    assert got == want


def test_hot_blocks_are_divided(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_GROUP", 5)
    rng = np.random.default_rng(2)
    codes = [int(c) for c in rng.integers(0, 2**63, 10)]
    codes += [codes[0] ^ (1 << i) for i in range(40)] + [codes[0] ^ (3 << i) ^ (1 << 50) for i in range(30)]
    df = spark.createDataFrame([(c,) for c in codes], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.gray_links(df, 2)).collect()}
    rows = [(i, c) for i, c in enumerate(codes)]
    hand = components_by_hand(rows)
    for i, a in enumerate(codes):
        for j, b in enumerate(codes):
            assert (roots.get(a, a) == roots.get(b, b)) == (hand[i] == hand[j] or a == b)


def shingle_set(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def test_keep_one_matches_brute_force(spark):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = list(rng.choice(words, int(rng.integers(30, 600))))
        for c in range(6):
            own = list(base)
            for _ in range(c * len(base) // 120):
                own[int(rng.integers(len(own)))] = "zz"
            rows.append((g * 10 + c, " ".join(own)))
    rows += [(500, ""), (501, None), (None, " "), (502, "one two"), (503, "One  two"), (None, "only null id"), (None, "only null id"), (504, "a b c d e f"), (504, "a b c d e f")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, th int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(str((r["doc_id"], r["text"])) for r in kept.collect())
    n = len(rows)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(n):
        for b in range(a):
            x, y = shingle_set(rows[a][1]), shingle_set(rows[b][1])
            if (rows[a][1] or "") == (rows[b][1] or "") or (x & y and len(x & y) >= 0.8 * len(x | y)):
                root[max(find(a), find(b))] = min(find(a), find(b))
    want = []
    for r in {find(i) for i in range(n)}:
        own = [rows[i] for i in range(n) if find(i) == r]
        want.append(min(own, key=lambda x: (x[0] is None, x[0] or 0)))
    assert len(got) == len(want)
    assert got == sorted(str(w) for w in want)
    assert simhash.keep_one(docs.limit(0)).count() == 0


def groups_by_hand(rows, similarity=0.8):
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and n >= similarity * (len(sets[a]) + len(sets[b]) - n):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(len(rows))]


def test_one_bucket_is_searched_whole(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 8, raising=False)
    plain = simhash._described

    def one_bucket(*args):
        run = plain(*args)

        def all_in_one(batches):
            for b in run(batches):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([[1]] * b.num_rows, pa.list_(pa.int64()))], ["doc_id", "th", "fp", "classes"])

        return all_in_one

    monkeypatch.setattr(simhash, "_described", one_bucket)
    rng = np.random.default_rng(21)
    words, rows = [f"w{i}" for i in range(4000)], []
    for _ in range(3):  # groups that drift: most of their texts are near to a few others only
        own = list(rng.choice(words, 120))
        for _ in range(25):
            for _ in range(2):
                own[int(rng.integers(len(own)))] = str(rng.choice(words))
            rows.append((len(rows), " ".join(own)))
    hand = groups_by_hand(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == sorted(set(hand))


def test_short_texts_match_brute_force(spark):
    rng = np.random.default_rng(4)
    words, rows = [f"w{i}" for i in range(3000)], []
    for n in [*range(5, 31), 60, 120, 195, 203, 204, 210, 240] * 2:
        own = list(rng.choice(words, n))
        more = max(1, (n - 4) // 4)
        rows += [own, [*own, *rng.choice(words, int(rng.integers(1, more + 1)))], [*rng.choice(words, more), *own]]
        if n > 15:
            rows.append([*own[: n // 2], "zz", *own[n // 2 :]])
    rows += [[*"all of these begin with the same common words".split(), *rng.choice(words, 3)] for _ in range(40)]
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    hand = groups_by_hand(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == sorted(set(hand))
