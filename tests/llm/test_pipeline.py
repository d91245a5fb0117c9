import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

pipeline = pytest.importorskip("corpus_pipeline")

PII = r"@|\+1 \(|\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b|\b4\d{15}\b|AKIA|password=|token ="


def test_each_stage_and_the_whole(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept, frames = docs, []
    for name, stage in pipeline.STAGES:
        out = pipeline.written(stage(spark, kept, sf), f"test-{name}")
        frames.append(out.toPandas().set_index("doc_id"))
        if name != "encoding":
            assert sorted(out.columns) == sorted(docs.columns)
        kept = out
    first, near, clean, private, tokens = frames
    seen = [d for d in labels if d in set(docs.toPandas()["doc_id"])]
    assert np.mean([(d in first.index) == bool(labels[d]) for d in seen]) > 0.9
    sets = {}
    for d, t in first["text"].items():
        w = t.lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(near.index) == {d for d in sets if find(d) == d}
    leaks = {d for d, t in near["text"].items() if any(i in " ".join(t.lower().split()) for i in items)}
    assert set(clean.index) == set(near.index) - leaks
    assert set(private.index) == set(clean.index)
    for d, t in private["text"].items():
        old = clean.loc[d, "text"]
        assert (t == old) or __import__("re").search(PII, old)
        assert private.loc[d, "n_chars"] == len(t)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for d, t in private["text"].items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert tokens.loc[d, "n_tokens"] == len(ids)
        assert tokens.loc[d, "ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    whole = pipeline.run(spark, sf).toPandas().set_index("doc_id")
    assert (whole.sort_index()["ids_sha256"] == tokens.sort_index()["ids_sha256"]).all()


def test_empty_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
