import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cladeloom.llm import suffix_dedup as sd


def by_hand(rows, size):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + size] for r in raw for i in range(len(r) - size + 1))
    out = []
    for (doc, _), r in zip(rows, raw, strict=True):
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - size + 1):
            if seen[r[i : i + size]] > 1:
                gone[i : i + size] = True
        kept = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum())
        out.append((str(doc), len(r), len(r) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def odd_rows():
    rng = random.Random(8)
    text = lambda n, letters="abcdefgh é": "".join(rng.choices(letters, k=n))
    shared, base = text(40), text(300)
    rows = [(1, None), (1, ""), (None, "short"), (2, text(15)), (3, base), (3, base), (None, base), (None, text(30))]
    for i in range(40):
        near = list(base)
        for _ in range(i % 4):
            near[rng.randrange(len(near))] = "Z"
        rows.append((100 + i, text(rng.randint(0, 50)) + (shared if i % 2 else "".join(near)) + text(rng.randint(0, 50))))
    rows += [(200, "ab" * 60), (201, "ab" * 9 + "c" + "aaaa" * 20), (202, "x" * 70), (203, "\0" * 30 + "q" + "\0" * 25), (204, shared[:24] + "\n" + shared[3:])]
    return rows


@pytest.mark.parametrize("hot", [200, 3])
def test_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(sd, "HOT_ANCHOR", hot)
    monkeypatch.setattr(sd, "WINDOWS_AT_ONCE", 50)
    monkeypatch.setattr(sd, "PIECE", 64)
    rows = odd_rows()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, th int, start int")
    out = sd.remove_repeats(docs, 24, 6)
    got = sorted((str(r[0]), r[1], r[2], r[3], hashlib.sha256(bytes(r[4])).hexdigest()) for r in out.collect())
    assert got == by_hand(rows, 24)


def test_long_text_and_empty_table(spark):
    rng = random.Random(3)
    long = "".join(rng.choices("abcdef ", k=700_000))
    rows = [(1, long), (2, "y" + long[650_000:650_450]), (3, long[: sd.PIECE + 10])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in sd.digests(docs).collect()}
    assert got == {1: (sd.PIECE + 10 + 450, 2), 2: (450, 1), 3: (sd.PIECE + 10, 1)}
    assert sd.digests(docs.limit(0)).count() == 0


def test_factors_by_hand():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 99, 60).astype(np.uint8)
    windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, 5))
    earlier, later = sd.factors(*sd.suffix_order(windows))
    at = [w.tobytes() for w in windows]
    assert earlier.tolist() == [w in at[:i] for i, w in enumerate(at)]
    assert later.tolist() == [w in at[i + 1 :] for i, w in enumerate(at)]


def test_remaining_text(spark):
    rng = random.Random(5)
    shared = "".join(rng.choices("abc é", k=500))
    rows = [(1, "first é " + shared + " ends"), (2, shared + "x"), (3, None), (4, "clean text é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sd.digests(docs)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == {1: "first é  ends", 2: "x", 3: "", 4: "clean text é"}
    half = "é" + shared  # the repeat begins with the second byte of a character
    cut = spark.createDataFrame([(1, half), (2, "\u0169" + shared)], "doc_id long, text string")
    assert {r["text"] for r in sd.digests(cut).collect()} == {"\ufffd"}
