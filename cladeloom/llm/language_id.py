"""Language identification by one bit-sliced Bloom filter that answers, for an n-gram, in which languages it occurs."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .suffix_dedup import _mix

SIZES = (1, 2, 3, 4, 5)  # letters of an n-gram; a word's borders count as letters
BITS = 1 << 21  # of each language's filter
HASHES = 3
GRAMS = 150_000  # n-grams of a language at most, those of most documents: about a fifth of the filter's bits
SAMPLE = 4_000  # documents of a language that its n-grams are learned from, those whose hash is lowest
RARE = 8  # an n-gram isn't a language's own if another has it at over RARE times the rate: a quotation, a name
AT_ONCE = 1 << 20  # letters handled together

_PAGE = 32_768
_ODD = np.uint64(0x9E3779B97F4A7C15)


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of the lower-cased texts as code points, everything else one zero, and the text each stands in. A zero begins and ends every text."""
    low = [f"\0{t.lower()}\0" for t in texts]
    raw = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    own = np.repeat(np.arange(len(low)), [len(t) for t in low])
    value = np.where(_letters()[raw], raw, 0)
    keep = np.concatenate(([True], (value[1:] != 0) | (value[:-1] != 0) | (own[1:] != own[:-1])))
    return value[keep], own[keep]


def grams(value: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size, hashes of the n-grams and their texts. A border is only first or last in an n-gram: none spans two words."""
    letter = value != 0
    wide = value.astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(value), np.uint64)
    inner = np.ones(len(value), bool)
    for n in range(1, max(SIZES) + 1):
        m = len(value) - n + 1
        if m <= 0:
            return
        h = h[:m] * _ODD + wide[n - 1 :]
        # all but the first and the last are letters
        inner = inner[:m] & letter[n - 2 : n - 2 + m] if n > 2 else inner[:m]
        if n in SIZES:
            use = letter if n == 1 else letter[:m] | letter[1:] if n == 2 else inner
            use = use & (own[:m] == own[n - 1 :]) if n > 1 else use
            at = np.flatnonzero(use)
            yield _mix(h[at] + np.uint64(n)), own[at]


def _pieces(texts: pa.Array) -> Iterator[tuple[list[int], list[str]]]:
    """Rows and texts of about AT_ONCE letters; a longer text comes in parts cut at white space, where no n-gram spans it."""
    rows: list[int] = []
    held: list[str] = []
    size = 0
    for k, text in enumerate(texts):
        t = text.as_py() or ""
        at = 0
        while True:
            end = len(t)
            if end - at > AT_ONCE:
                end = t.rfind(" ", at, at + AT_ONCE) + 1 or at + AT_ONCE
            rows.append(k)
            held.append(t[at:end])
            size += end - at + 1
            if size >= AT_ONCE:
                yield rows, held
                rows, held, size = [], [], 0
            if end == len(t):
                break
            at = end
    if rows:
        yield rows, held


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, docs): in how many of these documents each n-gram occurs."""
    for batch in batches:
        lang = batch.column(0).dictionary_encode()
        number = lang.indices.to_numpy()
        for rows, texts in _pieces(batch.column(1)):
            value, own = codes(texts)
            which = number[np.array(rows)]
            for h, at in grams(value, own):
                pair = _distinct(h, at)
                for one in np.unique(which):
                    key, n = np.unique(pair[0][which[pair[1]] == one], return_counts=True)
                    code = pa.array([lang.dictionary[int(one)].as_py()]).take(pa.array(np.zeros(len(key), np.int32)))
                    yield pa.RecordBatch.from_arrays([code, pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "docs"])


def _distinct(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each n-gram once per text."""
    order = np.lexsort((h, at))
    h, at = h[order], at[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (at[1:] != at[:-1]))) if len(h) else np.zeros(0, bool)
    return h[new], at[new]


def places(h: np.ndarray) -> list[np.ndarray]:
    """The HASHES bits of each n-gram hash in a filter."""
    second = _mix(h + _ODD) | np.uint64(1)
    return [((h + np.uint64(i) * second) % np.uint64(BITS)).astype(np.int64) for i in range(HASHES)]


def _gram_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = batch.column(1).to_numpy().view(np.uint64)
        for at in places(h):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at)], ["lang", "place"])


@dataclass
class Filters:
    """masks[s, place]: bit l tells that language 64 s + l has set the place; false_rate: of each language, from the bits it has set."""

    langs: list[str]
    prior: np.ndarray  # documents of each language in the training fold
    masks: np.ndarray
    false_rate: np.ndarray

    def languages_of(self, h: np.ndarray) -> np.ndarray:
        """Bit masks of all languages that hold each n-gram."""
        first, *more = places(h)
        found = self.masks[:, first]
        for at in more:
            found &= self.masks[:, at]
        return found

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """hits[text, language] of every n-gram size together, and the number of n-grams of each text."""
        value, own = codes(texts)
        hits, total = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for h, at in grams(value, own):
            found = self.languages_of(h)
            total += np.bincount(at, minlength=len(texts))
            for i in range(len(self.langs)):
                one = (found[i // 64] >> np.uint64(i % 64)) & np.uint64(1)
                hits[:, i] += np.bincount(at[one != 0], minlength=len(texts))
        return hits, total


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the doc_id as text leaves 2 when divided by 4; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE, most: int = GRAMS) -> Filters:
    """Filters of every language among the documents outside the held-out fold.

    N-grams are learned from at most `sample` documents of each language, a bound on what is fitted; the languages and how common
    each is come from all documents. An n-gram enters a language's filter if at least two of its documents hold it and no other
    language has it at RARE times the rate. Only bits come to the driver: BITS / 8 bytes a language.
    """
    spark = docs.sparkSession
    rows = docs.where(~held_out() & F.col("lang").isNotNull()).select(F.col("lang").cast("string"), F.col("text").cast("string"), F.xxhash64("doc_id", "text").alias("h"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    langs = sorted(sizes)
    slices = max(1, -(-len(langs) // 64))
    masks = np.zeros((slices, BITS), np.uint64)
    if not langs:
        return Filters([], np.zeros(0), masks, np.zeros(0))
    share = spark.createDataFrame([(k, min(1.0, 1.5 * sample / n + 100 / n)) for k, n in sizes.items()], "lang string, share double")
    # most rows are dropped before the sort that takes the lowest hashes
    few = rows.join(F.broadcast(share), "lang").where(F.col("h").cast("double") <= -(2.0**63) + F.col("share") * 2.0**64)
    first = Window.partitionBy("lang").orderBy("h")
    few = few.withColumn("k", F.row_number().over(first)).where(F.col("k") <= sample).select("lang", "text")
    taken = {k: min(n, sample) for k, n in sizes.items()}
    grams_of = few.mapInArrow(_learned, "lang string, gram long, docs long").groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))
    counted = spark.createDataFrame(list(taken.items()), "lang string, taken long")
    rate = grams_of.where("docs > 1").join(F.broadcast(counted), "lang").withColumn("rate", F.col("docs") / F.col("taken"))
    top = rate.withColumn("best", F.max("rate").over(Window.partitionBy("gram"))).where(F.col("rate") * RARE >= F.col("best"))
    most_used = Window.partitionBy("lang").orderBy(F.desc("docs"), "gram")
    own = top.withColumn("k", F.row_number().over(most_used)).where(F.col("k") <= most).select("lang", "gram")
    bits = own.mapInArrow(_gram_places, "lang string, place long")
    page = bits.select("lang", F.floor(F.col("place") / _PAGE).cast("int").alias("page"), (F.col("place") % _PAGE).alias("bit"))
    fill = np.zeros(len(langs))
    for r in page.groupBy("lang", "page").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():  # BITS / _PAGE rows of 4 KB a language
        i = langs.index(r["lang"])
        on = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
        masks[i // 64, r["page"] * _PAGE : (r["page"] + 1) * _PAGE] |= on.astype(np.uint64) << np.uint64(i % 64)
        fill[i] += on.sum() / BITS
    return Filters(langs, np.array([sizes[k] for k in langs], float), masks, fill**HASHES)


def decide(filters: Filters, hits: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language number and score of each text that has n-grams.

    Of `total` n-grams, hits = own + false_rate * (total - own): that gives each language's own n-grams. The most own n-grams decide,
    then the more common language, then the first by name. The score is the winner's share against the runner-up, over both.
    """
    own = np.clip((hits - total[:, None] * filters.false_rate) / (1 - np.minimum(filters.false_rate, 0.999)), 0, None)
    order = np.lexsort((np.arange(len(filters.langs)), -filters.prior))  # the common ones first
    best = order[np.argmax(own[:, order], axis=1)]
    rows = np.arange(len(own))
    top = own[rows, best]
    rest = own.copy()
    rest[rows, best] = -1
    second = np.maximum(rest.max(axis=1), 0) if own.shape[1] > 1 else np.zeros(len(own))
    missed = np.maximum(total - top, 0)  # n-grams that even the winner lacks speak against it
    return best, np.where(top > 0, top / np.maximum(top + second + 0.1 * missed, 1e-300), 0.0)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document row.

    The whole text is read. A text that is null or has no letter is `und` with score 0, as is every text if no language was learned;
    a text whose n-grams no language holds is given to the most common one with score 0. Languages are learned from rows whose doc_id
    is outside the held-out fold (a null doc_id is) and whose lang is not null. Repeated rows stay rows; other columns are not
    read; an empty table gives no rows.
    """
    filters = fit(docs, sample)
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            hits, total = np.zeros((batch.num_rows, len(own.langs))), np.zeros(batch.num_rows)
            for rows, texts in _pieces(batch.column(2)):
                h, n = own.counts(texts)
                np.add.at(hits, rows, h)
                np.add.at(total, rows, n)
            lang, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            if own.langs:
                best, sure = decide(own, hits, total)
                lang = [own.langs[b] if n else "und" for b, n in zip(best, total, strict=True)]
                score = np.where(total > 0, sure, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
