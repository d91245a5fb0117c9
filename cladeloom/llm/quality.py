"""Document quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import hashed_sample, written

PASSAGE_WORDS = 64
SAMPLE = 6_000  # labelled documents that the model is fitted on, at most
THRESHOLD = 0.7
CHUNK_BYTES = 250_000  # text encoded at once
BIGRAMS, WORDS = 64, 32  # hashed letter pairs and words
HIDDEN, GATE = 32, 16
EPOCHS, STEPS, BATCH, RATE, DECAY = 25, 600, 64, 3e-3, 1e-4  # at least so many epochs and steps

# byte classes: lower, upper, digit, each of the marks, lead and later bytes of other characters, all else
_MARKS = b"!#$%&*|.,'\"-:;()=_/?<>@[]"
_CLASS = np.full(256, 5 + len(_MARKS), np.int64)
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1] = 0, 1, 2
_CLASS[0x80:0xC0], _CLASS[0xC0:] = 3, 4
for _i, _b in enumerate(_MARKS):
    _CLASS[_b] = 5 + _i
CLASSES = int(_CLASS.max()) + 1
SCALARS = 6
FEATURES = CLASSES + BIGRAMS + WORDS + SCALARS
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of PASSAGE_WORDS words, and the number of passages of each text.

    Shares of byte classes, hashed letter pairs and hashed words, then: log words, mean word length, share of distinct words,
    of words equal to the one before, of line ends, and whether there is no word. A text without a word has one such passage.
    """
    raw = [t.encode() + b" " for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    inside = ~_SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    per_text = np.diff(np.searchsorted(start, np.cumsum([0] + [len(r) for r in raw])))
    count = np.maximum(1, -(-per_text // PASSAGE_WORDS))
    n = int(count.sum())
    first = np.cumsum(per_text) - per_text
    at = np.arange(len(start)) - np.repeat(first, per_text)
    word_p = np.repeat(np.cumsum(count) - count, per_text) + at // PASSAGE_WORDS
    words = np.bincount(word_p, minlength=n).astype(np.float32)
    out = np.zeros((n, FEATURES), np.float32)
    out[:, -1] = words == 0
    if not len(start):
        return out, count
    size = stop - start
    letters = np.flatnonzero(inside)
    byte_p = np.repeat(word_p, size)
    byte = data[letters].astype(np.int64)
    total = np.maximum(np.bincount(byte_p, minlength=n), 1)[:, None]
    out[:, :CLASSES] = np.bincount(byte_p * CLASSES + _CLASS[byte], minlength=n * CLASSES).reshape(n, -1) / total
    pair = (byte[:-1] * 31 + byte[1:] * 17) % BIGRAMS
    same = letters[1:] == letters[:-1] + 1
    out[:, CLASSES : CLASSES + BIGRAMS] = np.bincount((byte_p[:-1] * BIGRAMS + pair)[same], minlength=n * BIGRAMS).reshape(n, -1) / total
    begin = np.cumsum(size) - size
    power = np.multiply.accumulate(np.full(int(size.max()), _ODD))
    h = np.add.reduceat((byte.astype(np.uint64) + np.uint64(1)) * power[np.arange(len(byte)) - np.repeat(begin, size)], begin)
    h = (h ^ (h >> np.uint64(32))) * _ODD >> np.uint64(24)
    some = np.maximum(words, 1)
    kind = (h % np.uint64(WORDS)).astype(np.int64)
    out[:, CLASSES + BIGRAMS : -SCALARS] = np.bincount(word_p * WORDS + kind, minlength=n * WORDS).reshape(n, -1) / some[:, None]
    repeat = np.concatenate(([False], (h[1:] == h[:-1]) & (word_p[1:] == word_p[:-1])))
    out[:, -6] = np.log1p(words)
    out[:, -5] = np.bincount(word_p, weights=size, minlength=n) / some
    out[:, -4] = np.bincount(_distinct(word_p, h), minlength=n) / some
    out[:, -3] = np.bincount(word_p, weights=repeat, minlength=n) / some
    out[:, -2] = np.bincount(word_p, weights=data[stop] == 10, minlength=n) / some
    return out, count


def _distinct(group: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The group of each distinct (group, h)."""
    order = np.lexsort((h, group))
    group, h = group[order], h[order]
    return group[np.concatenate(([True], (group[1:] != group[:-1]) | (h[1:] != h[:-1])))]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class GatedAttention:
    """Passage encoder, gated attention over the passages of a document, and a logistic score of the weighted sum."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        shapes = {"W": (len(mean), HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "a": (GATE,), "w": (HIDDEN,), "c": (1,)}
        self.p = {k: (rng.normal(0, s[0] ** -0.5, s) if len(s) > 1 or k in "aw" else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
        self.mean, self.scale = mean, scale

    def forward(self, x: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
        p, first = self.p, np.cumsum(count) - count
        x = np.clip((x - self.mean) / self.scale, -5, 5)
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (v * u) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), count))
        weight = e / np.repeat(np.add.reduceat(e, first), count)
        z = np.add.reduceat(weight[:, None] * h, first)
        return {"x": x, "h": h, "v": v, "u": u, "weight": weight, "z": z, "score": _sigmoid(z @ p["w"] + p["c"])}

    def gradients(self, f: dict[str, np.ndarray], count: np.ndarray, y: np.ndarray, importance: np.ndarray) -> dict[str, np.ndarray]:
        p, first = self.p, np.cumsum(count) - count
        d = (f["score"] - y) * importance / importance.sum()
        dz = np.repeat(d[:, None] * p["w"], count, axis=0)
        dweight = (dz * f["h"]).sum(axis=1)
        de = f["weight"] * (dweight - np.repeat(np.add.reduceat(f["weight"] * dweight, first), count))
        dgate = de[:, None] * p["a"]
        dv, du = dgate * f["u"] * (1 - f["v"] ** 2), dgate * f["v"] * f["u"] * (1 - f["u"])
        dh = dz * f["weight"][:, None] + dv @ p["V"].T + du @ p["U"].T
        dpre = dh * (1 - f["h"] ** 2)
        return {
            "W": f["x"].T @ dpre, "b": dpre.sum(axis=0), "V": f["h"].T @ dv, "U": f["h"].T @ du,
            "a": (f["v"] * f["u"]).T @ de, "w": f["z"].T @ d, "c": d.sum(keepdims=True),
        }

    def fit(self, x: np.ndarray, count: np.ndarray, y: np.ndarray, seed: int = 11) -> None:
        """Adam on the cross entropy, both labels with equal weight."""
        share = np.clip(y.mean(), 0.01, 0.99)
        importance = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        first = np.cumsum(count) - count
        rng, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        epochs = max(EPOCHS, -(-STEPS * BATCH // len(y)))
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(order), BATCH):
                own = order[at : at + BATCH]
                n = count[own]
                rows = np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
                g = self.gradients(self.forward(x[rows], n), n, y[own], importance[own])
                step += 1
                rate = RATE * (1 - epoch / epochs) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                for k, w in self.p.items():
                    m[k] += 0.1 * (g[k] - m[k])
                    s[k] += 0.001 * (g[k] ** 2 - s[k])
                    w -= rate * m[k] / (np.sqrt(s[k]) + 1e-8) + RATE * DECAY * w


def _by_chunk(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_BYTES:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column(2).to_pylist()]
        for a, b in _by_chunk(texts):
            x, count = passages(texts[a:b])
            bags = pa.array([p.tobytes() for p in np.split(x, np.cumsum(count)[:-1])], pa.binary())
            own = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), bags], ["doc_id", "label", "bag"])


def held_out(doc_id: Column) -> Column:
    """True for the fold that no label is taken from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> GatedAttention | None:
    """A model fitted on at most `sample` labelled documents outside the held-out fold: those whose doc_id hashes lowest.

    Null labels, null doc_ids and labels without a document are left out. Without any label there is no model.
    """
    own = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    own = own.select("doc_id", F.col("quality").cast("int").alias("label"))
    own = written(own.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "labelled")
    own = hashed_sample(own, ["doc_id", "label"], sample)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(own), "doc_id").select("doc_id", "label", "text")  # `sample` rows at most
    bags = rows.mapInArrow(_encoded, "doc_id long, label int, bag binary").collect()
    if not bags:
        return None
    bags.sort(key=lambda r: (r["doc_id"], r["label"], bytes(r["bag"])))
    parts = [np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in bags]
    x, count = np.concatenate(parts), np.array([len(p) for p in parts])
    model = GatedAttention(x.mean(axis=0), x.std(axis=0) + 1e-3)
    model.fit(x, count, np.array([r["label"] for r in bags], np.float32))
    return model


def _scores(model: GatedAttention):
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            texts = texts.fillna("").tolist()
            out = np.empty(len(texts))
            for a, b in _by_chunk(texts):
                x, count = passages(texts[a:b])
                out[a:b] = model.forward(x, count)["score"]
            yield pd.Series(out)

    return score


def quality_score(text: Column, model: GatedAttention | None) -> Column:
    """Score of each whole text, 0 to 1; a null text counts as an empty one, and without a model every score is 1."""
    return _scores(model)(text.cast("string")) if model else F.lit(1.0)


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document row; only the text is an input of a score."""
    model = fit(docs, labels, sample)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality_score(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score of at least the threshold, with their columns."""
    return docs.where(quality_score(F.col("text"), fit(docs, labels, sample)) >= threshold)
