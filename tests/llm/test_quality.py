import zlib

import numpy as np

from cladeloom.llm import quality


def test_features_by_hand():
    texts = ["", "Ab ab ab. é", " \n", "x " * 130 + "| y\nz", "!!!"]
    x, count = quality.passages(texts)
    assert count.tolist() == [1, 1, 1, 3, 1]
    alone = [quality.passages([t])[0] for t in texts]
    np.testing.assert_allclose(x, np.concatenate(alone))
    empty, four = x[0], x[1]
    assert empty[-1] == 1 and empty[:-1].sum() == 0 and (x[2] == empty).all()
    letters = "Ab ab ab. é".encode().replace(b" ", b"")
    assert np.isclose(four[0], 5 / len(letters)) and np.isclose(four[1], 1 / len(letters))
    assert np.isclose(four[-6], np.log1p(4)) and np.isclose(four[-5], len(letters) / 4) and four[-4] == 1 and four[-3] == 0
    assert np.isclose(x[3][-4], 1 / 64) and np.isclose(x[3][-3], 63 / 64)
    assert np.isclose(x[5][-2], 1 / 5)  # the last passage: x x | y newline z


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    count = np.array([1, 3, 2])
    x, y, w = rng.normal(size=(6, quality.FEATURES)), np.array([0.0, 1, 1]), np.array([1.0, 2, 0.5])
    m = quality.GatedAttention(np.zeros(quality.FEATURES), np.ones(quality.FEATURES))
    m.p = {k: v.astype(float) for k, v in m.p.items()}

    def loss():
        s = m.forward(x, count)["score"]
        return -((y * np.log(s) + (1 - y) * np.log(1 - s)) * w).sum() / w.sum()

    g = m.gradients(m.forward(x, count), count, y, w)
    for k, v in m.p.items():
        i = tuple(rng.integers(0, n) for n in v.shape)
        v[i] += 1e-5
        up = loss()
        v[i] -= 2e-5
        assert np.isclose((up - loss()) / 2e-5, g[k][i], atol=1e-6), k
        v[i] += 1e-5


def test_held_out_accuracy_and_odd_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (5000, "", "en", "s", 0), (5000, None, "en", "s", 0), (5001, "word " * 60_000, None, "s", 1)], docs.schema)
    more = spark.createDataFrame([(None, 1, 0), (5000, None, 0), (99999, 0, 0)], labels.schema)
    out = quality.scored(docs.union(odd), labels.union(more)).toPandas()
    assert len(out) == docs.count() + 4
    assert out["score"].between(0, 1).all() and (out["predicted"] == (out["score"] >= 0.7)).all()
    ids = out["doc_id"].dropna().astype(int)
    assert (out.loc[ids.index, "held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in ids]).all()
    seen = out.merge(labels.toPandas(), on="doc_id")
    seen = seen[seen["held_out"]]
    assert (seen["predicted"] == seen["quality"]).mean() > 0.9
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert quality.scored(docs.limit(0), labels).count() == 0
    assert quality.scored(docs.limit(3), labels.limit(0)).select("score").collect() == [(1.0,)] * 3
