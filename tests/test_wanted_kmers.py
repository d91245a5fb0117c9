"""K-mers of targets that no query holds never become rows, whatever the letters, and no shared one is lost."""

import random

from cladeloom.operators.similarity import _likely_kmers, kmer_bits, kmer_join


def test_only_wanted_kmers_leave_a_target(spark):
    rnd = random.Random(3)
    text = "".join(rnd.choice("acgté\U0001f600") for _ in range(70_000))
    t = spark.createDataFrame([(1, text), (2, "acg"), (3, "")], "rep long, seq string")
    wanted = {text[i : i + 8] for i in (0, 5, 65_530, 65_536, 69_992)}
    got = {tuple(r) for r in _likely_kmers(t, "target", 8, spark.createDataFrame([(w,) for w in wanted] + [("zzzzzzzz",)], "kmer string")).collect()}
    assert {(1, w) for w in wanted} <= got and len(got) <= len(wanted) + 3
    assert len(kmer_bits("abc", 5)) == 0 and len(kmer_bits("abcdef", 5)) == 2


def test_pairs_at_the_share_asked_for(spark):
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abcd") for _ in range(n))
    q = {i: word(60) for i in range(5)}
    t = {10 * i + j: s[:20 + 4 * j] + word(20) for i, s in q.items() for j in range(10)}
    sets = lambda d: {i: {s[p : p + 6] for p in range(len(s) - 5)} for i, s in d.items()}
    kq, kt = sets(q), sets(t)
    frame = lambda d: spark.createDataFrame(list(d.items()), "rep long, seq string")
    for share in (0.05, 0.5, 1.0):
        want = {(a, b): len(x & y) for a, x in kq.items() for b, y in kt.items() if x & y and len(x & y) >= share * len(x)}
        assert {(r.query, r.target): r.n_shared for r in kmer_join(frame(q), frame(t), 6, share).collect()} == want
