"""Language identification: filters against sets, the decision on made texts, held-out accuracy."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeloom.llm import language_id as L

SCHEMA = "doc_id long, text string, lang string, score double, held_out string, h long"
EN = ["the house is near the river and the people walk there", "they were thinking about what should happen with the other things"]
DE = ["das haus ist nahe am fluss und die leute gehen dorthin", "sie dachten darüber nach was mit den anderen dingen geschehen soll"]


def rows_of(texts, lang, start):
    return [(start + i, t, lang, 0.5, "clash", 1) for i, t in enumerate(texts)]


def set_of(text):
    """N-grams in plain Python: letters of a word with a border on each side."""
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            w = "_" + word + "_"
            out += [w[i : i + n] for n in L.SIZES for i in range(len(w) - n + 1) if w[i : i + n].strip("_")]
            word = ""
    return out


@pytest.mark.parametrize("texts", [["Das Haus, am Fluß!", "", "12 3", "é"], ["a" * 30, "İstanbul 42x \U0001f600 ok", "x\x00y"]])
def test_grams_of_each_text(texts):
    value, own = L.codes(texts)
    n = sum(np.bincount(at, minlength=len(texts)) for _, at in L.grams(value, own))
    assert n.tolist() == [len(set_of(t)) for t in texts]
    hashes = [np.concatenate([h[at == i] for h, at in L.grams(value, own)]) for i in range(len(texts))]
    assert [len(np.unique(h)) for h in hashes] == [len(set(set_of(t))) for t in texts]


def test_cases_and_accuracy(spark):
    docs = rows_of([t + f" {i}" for i in range(40) for t in EN], "en", 0) + rows_of([t + f" {i}" for i in range(40) for t in DE], "de", 1000)
    docs += [(2000, None, "en", 0.1, "", 2), (2001, "", "en", 0.1, "", 2), (2002, "123 - 4!", "de", 0.1, "", 2), (2003, "漢字", "de", 0.1, "", 2)]
    docs += [(None, EN[0], None, None, None, None), (0, EN[0], "en", 0.5, "clash", 1), (2004, "the river " * 200_000, None, None, None, None), (2005, "und das haus", None, None, None, None)]
    out = L.identify(spark.createDataFrame(docs, SCHEMA).repartition(3))
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = out.collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert [by[i].lang_pred for i in (2000, 2001, 2002)] == ["und"] * 3 and by[2000].score == 0
    assert by[2003].lang_pred in ("en", "de") and by[2003].score == 0
    assert by[2004].lang_pred == "en" and by[2005].lang_pred == "de" and by[None].lang_pred == "en" and by[None].held_out is False
    assert all(by[i].lang_pred == "en" for i in range(80)) and all(by[i].lang_pred == "de" for i in range(1000, 1080))
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {(r.doc_id, r.lang_pred, r.score) for r in L.identify(docs).collect()} == {(1, "und", 0.0), (2, "und", 0.0)}
    assert L.identify(docs.limit(0)).collect() == []


def test_more_languages_than_one_mask_holds(spark):
    made = [(100 * i + j, " ".join(chr(0x4E00 + 50 * i + (j + k) % 40) * 2 for k in range(12)), f"l{i:02d}") for i in range(70) for j in range(12)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")
    got = L.identify(docs).join(docs, "doc_id")
    assert got.where("lang = lang_pred").count() == len(made)


def test_false_positives_are_corrected():
    filters = L.Filters(["a", "b"], np.array([1.0, 5.0]), np.zeros((1, 1), np.uint64), np.array([0.5, 0.0]))
    best, score = L.decide(filters, np.array([[60.0, 30.0], [50.0, 0.0], [100.0, 100.0]]), np.array([100.0, 100.0, 100.0]))
    # 60 hits at a false rate of one half are 20 own n-grams; 50 are none, and then the more common language is given
    assert best.tolist() == [1, 1, 1] and score[1] == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
