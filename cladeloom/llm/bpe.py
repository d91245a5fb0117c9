"""Byte-pair encoding and decoding with an index of pair occurrences."""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS = 1_000_000  # characters of text that are encoded at once
TABLE_SYMBOLS = 1_000_000  # a worker forgets the words it has encoded beyond so many symbols
NO_RANK = np.iinfo(np.int64).max


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 bytes are themselves, the others follow from code point 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Vocabulary:
    """What a tokenizer file says: NFC, lower case, a splitting pattern, byte letters, merges with a word-end suffix, and no decoder."""

    def __init__(self, content: str) -> None:
        spec = json.loads(content)
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or spec["decoder"] is not None:
            raise ValueError("the file must hold a BPE model with a word-end suffix and no decoder")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.words = regex.compile(splits[0]["pattern"]["Regex"]).findall
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + end] for c in letters], np.int32)
        size = max([*vocab.values(), *self.special.values()]) + 1
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        self.left, self.right, self.made = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        keys = self.left * size + self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys, self.size = keys[self.order], size
        self.first_use = np.full(size, NO_RANK)
        for side in (self.left, self.right):
            np.minimum.at(self.first_use, side, np.arange(len(side)))
        self.token = [b""] * size
        for text, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = text.encode()

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NO_RANK where it has none."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NO_RANK)

    def normal(self, text: str) -> str:
        """NFC, then each character to lower case by itself: a final sigma gets no form of its own. White space is dropped later."""
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()


@lru_cache(2)
def vocabulary(content: str) -> Vocabulary:
    return Vocabulary(content)


def merge_words(v: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of distinct words, end to end, and where each word ends.

    All symbols stand in one linked list. The index maps the rank of a pair to every position where it was seen; ranks are
    taken from a heap in ascending order, all live occurrences of a rank are merged at once, and only the pairs beside
    them are looked up again and filed.
    """
    raw = [w.encode() for w in words]
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
    data = np.frombuffer(b"".join(raw), np.uint8)
    sym = v.inner[data].astype(np.int64)
    sym[ends - 1] = v.final[data[ends - 1]]
    n = len(sym)
    word = np.repeat(np.arange(len(raw)), np.diff(ends, prepend=0))
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends - 1] = -1
    before[np.concatenate(([0], ends[:-1]))] = -1
    alive = np.ones(n, bool)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def file(at: np.ndarray) -> None:
        at = at[after[at] >= 0]
        ranks = v.rank(sym[at], sym[after[at]])
        keep = ranks != NO_RANK
        at, ranks = at[keep], ranks[keep]
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for part in np.split(at, cuts) if len(at) else ():
            r = int(v.rank(sym[part[:1]], sym[after[part[:1]]])[0])
            if r not in index:
                index[r] = []
                heapq.heappush(heap, r)
            index[r].append(part)

    file(np.arange(n))
    while heap:
        r = heapq.heappop(heap)
        at = np.unique(np.concatenate(index.pop(r)))
        a, b, made = v.left[r], v.right[r], v.made[r]
        nxt = after[at]
        at = at[alive[at] & (nxt >= 0) & (sym[at] == a) & (sym[nxt] == b)]
        if a == b and len(at) > 1:  # of a run of overlapping occurrences every other one counts, from the left
            chained = np.concatenate(([False], after[at[:-1]] == at[1:]))
            start = np.flatnonzero(~chained)
            at = at[(np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))) % 2 == 0]
        if v.first_use[made] < r and len(at) > 1:  # the new symbol may take part in an earlier merge: one a word, then look again
            lead = np.concatenate(([True], word[at[1:]] != word[at[:-1]]))
            if not lead.all():
                index[r] = [at[~lead]]
                heapq.heappush(heap, r)
                at = at[lead]
        if not len(at):
            continue
        gone = after[at]
        sym[at] = made
        alive[gone] = False
        after[at] = after[gone]
        follow = after[at]
        before[follow[follow >= 0]] = at[follow >= 0]
        prev = before[at]
        file(np.unique(np.concatenate((at, prev[prev >= 0]))))
    return sym[alive].astype(np.uint32), np.cumsum(np.bincount(word[alive], minlength=len(raw)))


class _Words(dict):
    """Number of each word seen, in order of first sight."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    """Encodes texts in chunks; words already seen by this worker are not merged again."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.forget()

    def forget(self) -> None:
        self.number = _Words()
        self.ids, self.ends = np.empty(0, np.uint32), np.zeros(1, np.int64)
        for text, i in self.v.special.items():  # special tokens take the first numbers, under names that no word can have
            self.number["\0" + text]
            self.ids, self.ends = np.append(self.ids, np.uint32(i)), np.append(self.ends, self.ends[-1] + 1)

    def _numbers(self, text: str) -> np.ndarray:
        out: list[str] = []
        for k, part in enumerate(self.v.cut(text)):
            out += ["\0" + part] if k % 2 else self.v.words(self.v.normal(part))
        return np.fromiter(map(self.number.__getitem__, out), np.int64, len(out))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.ids) > TABLE_SYMBOLS:
            self.forget()
        known = len(self.number)
        docs = [self._numbers(t) for t in texts]
        if len(self.number) > known:
            ids, ends = merge_words(self.v, list(self.number)[known:])
            self.ids, self.ends = np.concatenate((self.ids, ids)), np.concatenate((self.ends, self.ends[-1] + ends))
        out = []
        for d in docs:
            first, size = self.ends[d], self.ends[d + 1] - self.ends[d]
            out.append(self.ids[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())])
        return out


def decode(v: Vocabulary, ids: np.ndarray) -> bytes:
    """The tokens of ids with a space between them: what a tokenizer without a decoder gives, special tokens included."""
    return b" ".join(map(v.token.__getitem__, ids.tolist()))


@lru_cache(1)
def _encoder(content: str) -> Encoder:
    return Encoder(vocabulary(content))


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > CHUNK_CHARS:
            yield at, k
            at, size = k, 0
        size += len(t)
    if len(texts) > at:
        yield at, len(texts)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row: ids as little-endian unsigned 32-bit integers, decoded from those ids.

    The tokenizer file is read once, on the driver, and goes to the workers with the code. A null text counts as an empty
    one: no ids, empty decoded text. Repeated rows and null ids stay rows. Texts are taken in chunks of CHUNK_CHARS
    characters, a longer text by itself.
    """
    content = Path(path).read_text(encoding="utf-8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _chunks(texts):
                ids = encoder.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                        pa.array([decode(encoder.v, x).decode() for x in ids], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    out = encode_documents(docs, path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
