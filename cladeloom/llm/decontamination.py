"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact weighted-shingle similarity."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 19  # bits of 64; a window at similarity 0.8 differs in about 10 with a deviation of 3
BLOCKS = 4
ITEMS_AT_ONCE = 500  # benchmark items of one pass over the documents
WORDS_AT_ONCE = 100_000  # and their words
CHUNK_BYTES = 250_000  # text hashed at once

MATCH = "array<struct<item_id:bigint,start:int,words:int,distance:int,similarity:double>>"

_ODD = np.uint64(0x9E3779B97F4A7C15)
_PARTS = np.ones(256, bool)
_PARTS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, end to end, and where each text ends.

    A word is a run of ASCII letters, digits and non-ASCII characters of the lower-cased text; the rest parts words.
    """
    raw = [t.lower().encode() + b" " for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    inside = ~_PARTS[data]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    size = stop - start
    power = np.multiply.accumulate(np.full(int(size.max()), _ODD))
    letters = np.flatnonzero(inside)
    first = np.cumsum(size) - size
    offset = np.arange(len(letters)) - np.repeat(first, size)
    sums = np.add.reduceat((data[letters].astype(np.uint64) + np.uint64(1)) * power[offset], first)
    ends = np.searchsorted(start, np.cumsum([len(r) for r in raw]))
    return _mix(sums ^ (size.astype(np.uint64) << np.uint64(48))), ends


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles."""
    n = len(words) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h = np.full(n, np.uint64(k))
    for j in range(k):
        h = (h ^ words[j : j + n]) * _ODD
    return _mix(h)


def simhash(hashes: np.ndarray) -> np.uint64:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * bits > len(hashes), bitorder="little").view(np.uint64)[0]


class HammingIndex:
    """Codes filed under every value of each block of bits that is near their own.

    Codes within the radius differ in at most radius // blocks bits of some block, so looking up a code's own block values
    finds all codes within the radius; the candidates are then compared in full.
    """

    def __init__(self, codes: np.ndarray, radius: int, blocks: int = BLOCKS) -> None:
        self.codes, self.radius, self.width = codes, radius, 64 // blocks
        masks = [0]
        for n in range(1, radius // blocks + 1):
            masks += [sum(1 << b for b in c) for c in combinations(range(self.width), n)]
        self.tables = []
        for b in range(blocks):
            keys = (self.block(codes, b)[:, None] ^ np.array(masks, np.int64)).ravel()
            order = np.argsort(keys, kind="stable")
            self.tables.append((np.searchsorted(keys[order], np.arange((1 << self.width) + 1)), (order // len(masks)).astype(np.int32)))

    def block(self, codes: np.ndarray, b: int) -> np.ndarray:
        return ((codes >> np.uint64(b * self.width)) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def near(self, code: np.uint64) -> list[tuple[int, int]]:
        """(position, distance) of the codes within the radius."""
        one = np.array([code])
        parts = []
        for b, (at, which) in enumerate(self.tables):
            v = int(self.block(one, b)[0])
            parts.append(which[at[v] : at[v + 1]])
        found = np.unique(np.concatenate(parts))
        distance = np.bitwise_count(self.codes[found] ^ code)
        return [(int(i), int(d)) for i, d in zip(found, distance, strict=True) if d <= self.radius]


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Sum of the smaller counts over the sum of the larger ones."""
    both = (a & b).total()
    return both / (a.total() + b.total() - both)


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


class Items:
    """Benchmark items of one pass, grouped by number of words; items without a word are left out."""

    def __init__(self, rows: list[tuple[int, str]], k: int, similarity: float, radius: int) -> None:
        words, ends = word_hashes([t for _, t in rows])
        by_size = defaultdict(list)
        for (item, _), w in zip(rows, np.split(words, ends[:-1]), strict=True):
            if len(w):
                by_size[len(w)].append((item, shingles(w, min(k, len(w)))))
        self.k, self.similarity, self.sizes, self.items = k, similarity, [], []
        self.grams: dict[int, np.ndarray] = {}
        codes = []
        for n, own in sorted(by_size.items()):
            k_n = min(k, n)
            codes += [simhash(g) for _, g in own]
            self.items += [(i, n, Counter(g.tolist())) for i, g in own]
            grams = np.unique(np.concatenate([g for _, g in own]))
            self.sizes.append((n, k_n, grams))
            self.grams[k_n] = np.union1d(self.grams.get(k_n, np.empty(0, np.uint64)), grams)
        self.index = HammingIndex(np.array(codes, np.uint64), radius)

    def matches(self, words: np.ndarray) -> list[dict]:
        """Per item the most similar window of its size (the whole text where that is shorter; ties: the first), if similar enough."""
        best: dict[int, tuple] = {}
        per_k = {}
        for k, grams in self.grams.items():
            own = shingles(words, k)
            hit = _member(grams, own)
            if hit.any():
                per_k[k] = own, np.flatnonzero(hit)
        for n, k, grams in self.sizes:
            if k not in per_k:
                continue
            own, at = per_k[k]
            m = min(n - k + 1, len(own))
            # a window as similar as asked for holds at least this many shingles of items of its size: others need no fingerprint
            need = max(1, math.ceil(self.similarity * (n - k + 1) - 1e-9))
            if len(at) < need or np.count_nonzero(inside := _member(grams, own[at])) < need:
                continue
            hit = np.zeros(len(own), np.int64)
            hit[at[inside]] = 1
            hits = np.concatenate(([0], np.cumsum(hit)))
            for start in np.flatnonzero(hits[m:] - hits[:-m] >= need).tolist():
                window = own[start : start + m]
                near = [(self.items[pos], d) for pos, d in self.index.near(simhash(window)) if self.items[pos][1] == n]
                mine = Counter(window.tolist()) if near else None
                for (item, _, count), distance in near:
                    s = weighted_similarity(mine, count)
                    if s >= self.similarity and s > best.get(item, (0.0,))[0]:
                        best[item] = (s, start, min(n, len(words)), distance)
        return [{"item_id": i, "start": b[1], "words": b[2], "distance": b[3], "similarity": b[0]} for i, b in sorted(best.items())]


def _marker(rows: list[tuple[int, str]], k: int, similarity: float, radius: int):
    @F.pandas_udf(MATCH)
    def mark(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        items = Items(rows, k, similarity, radius)
        for texts in batches:
            out, chunk, size = [], [], 0

            def settle() -> None:
                words, ends = word_hashes(chunk)
                out.extend(items.matches(w) for w in np.split(words, ends[:-1]))

            for t in texts:
                chunk.append(t or "")
                size += len(chunk[-1])
                if size >= CHUNK_BYTES:
                    settle()
                    chunk, size = [], 0
            if chunk:
                settle()
            yield pd.Series(out, dtype=object)

    return mark


def _passes(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in pieces of bounded size, in the order of its ids; the driver holds one piece at a time."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    rows = rows.where("item_id is not null and text is not null").distinct().orderBy("item_id", "text")
    piece, size = [], 0
    for item, text in rows.toLocalIterator():
        n = len(re.findall(r"\S+", text))
        if piece and (len(piece) >= ITEMS_AT_ONCE or size + n > WORDS_AT_ONCE):
            yield piece
            piece, size = [], 0
        piece.append((item, text))
        size += n
    if piece:
        yield piece


def leaks(text: Column, benchmark: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> Column:
    """The benchmark items that each text holds, as an array of (item_id, start word, words, distance, similarity).

    Every window with as many words as an item is a candidate. Its SimHash finds the items within the radius through blocks of
    bits, and the similarity of the shingle counts decides (items of fewer than k words are one shingle). Windows that hold
    too few shingles of any item to be similar to one get no fingerprint; none of those could pass. Null and empty texts, and
    items that are null or have no word, match nothing; a null item_id drops out. The benchmark is a query set: it is held
    against all texts in passes of at most ITEMS_AT_ONCE items and WORDS_AT_ONCE words (a longer item by itself).
    """
    arrays = [_marker(piece, k, similarity, radius)(text) for piece in _passes(benchmark)]
    return F.concat(*arrays) if arrays else F.lit(None).cast(MATCH)


def contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """One row per document row and leaked item: doc_id, item_id, start, words, distance, similarity."""
    found = docs.select(F.col("doc_id").cast("long"), leaks(F.col("text").cast("string"), benchmark, **how).alias("found"))
    return found.select("doc_id", F.inline("found"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that hold no benchmark item, with their columns."""
    found = leaks(F.col("text").cast("string"), benchmark, **how)
    return docs.where(F.coalesce(F.size(found), F.lit(0)) <= 0)
