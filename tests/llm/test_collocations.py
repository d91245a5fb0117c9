"""Phrase collocations against counting in plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

from cladeloom.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, phrase string, n long, h long, grp long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, least, top):
    counts, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOW)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        dropped = set()
        for p, a in cand.items():
            for k in range(2, len(p)):
                dropped |= {p[i : i + k] for i in range(len(p) - k + 1) if 100 * a >= 80 * f[p[i : i + k]]}
        best = []
        for p, a in cand.items():
            if p not in dropped:
                score, j = min((2000000 * a // (f[p[:j]] + f[p[j:]]), j) for j in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), f[p[:j]], f[p[j:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(best)[:top], 1):  # noqa: E741
            out.add((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return out


def made(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "ÉTÉ", "été", "a\x1cb", "x", " y", "zoo", "\U0001f600"]
    rows = [(None, "en"), ("", "en"), ("  \t ", None), (".,;", "xx"), ("alone", "yy")]
    for _ in range(n):
        picked = [rng.choice(words[: rng.choice([2, 5, 11])]) for _ in range(rng.randrange(60))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ", ", ";"]) for w in picked)
        rows.append((text, rng.choice(["en", "en", "de", None, ""])))
    rows += [("new york city hall is new york city hall " * 40, "en")] * 3  # repeated rows, and a long text without a border
    rows += [("hot line of words. " * 2000, "de")]
    return rows


# a budget of 80 makes prefixes of all lengths over-full, and whole suffixes that go by block
@pytest.mark.parametrize("budget", [C.BUDGET, 80])
def test_counts_and_scores(spark, budget):
    rows = made(3, 150)
    docs = spark.createDataFrame([(i, t, g, "clash", 1, 2, 3) for i, (t, g) in enumerate(rows)], SCHEMA).repartition(5)
    got = C.collocations(docs, 5, 40, budget)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == by_hand(rows, 5, 40)


def test_phrase_counts_over_many_groups(spark):
    rows = made(4, 80)
    docs = spark.createDataFrame([(i, t, g, None, None, None, None) for i, (t, g) in enumerate(rows)], SCHEMA).repartition(3)
    one, _ = C.phrase_counts(docs, 3)
    many, _ = C.phrase_counts(docs, 3, 40)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect())) != []


def test_texts_longer_than_a_chunk(monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 50)
    raw = b"a b c d e f g h. " * 20 + b"x " * 200
    parts = list(C._slices(raw))
    assert len(parts) > 3 and b"\n".join(parts) == raw.translate(C._LOWER)
    whole = [(w.as_py(), int(p)) for w, p in zip(*C.tokens(raw))]
    cut = [(w.as_py(), i, int(p)) for i, part in enumerate(parts) for w, p in zip(*C.tokens(part))]
    assert [w for w, _ in whole] == [w for w, *_ in cut]
    assert [a == b for (_, a), (_, b) in zip(whole, whole[1:])] == [a[1:] == b[1:] for a, b in zip(cut, cut[1:])]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert C.collocations(docs, 2, 5).collect() == []
