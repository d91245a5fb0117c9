import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow.dataset as ds
import pytest
from tokenizers import Tokenizer

from cladeloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts():
    rng = random.Random(5)
    alphabet = "aabbeetthnis   \n\t'’.,!#1234567890éÉßñΣσςİıÅÅ你好안녕é  \u0085\x1c🙂👩‍👩‍👧ͅǅŉﬁ½²Ⅷ<|>"
    fixed = ["", " ", "It's we'll I'D they've", "<|startoftext|>a<|endoftext|> b<|ENDOFTEXT|>", "aaaaaaaaaaaaaaaa", "ΑΣ ΑΣΑ", "x" * 5000, "!" * 999]
    return fixed + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(3000)]


def check(library, rows, texts):
    for text, (ids, decoded) in zip(texts, rows, strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == want, text
        assert decoded == library.decode(want, skip_special_tokens=False), text


def test_equals_the_library_on_odd_texts(library):
    v = bpe.Vocabulary(open(PATH, encoding="utf-8").read())
    encoder = bpe.Encoder(v)
    texts = odd_texts()
    for part in (texts[:7], texts[7:]):
        ids = encoder.encode(part)
        check(library, [(x.tolist(), bpe.decode(v, x).decode()) for x in ids], part)


def test_repeated_letters_and_early_uses(library):
    v = bpe.Vocabulary(open(PATH, encoding="utf-8").read())
    words = sorted({"".join(random.Random(i).choices("ab" if i % 2 else "the", k=i % 23 + 1)) for i in range(4000)})
    ids, ends = bpe.merge_words(v, words)
    for w, part in zip(words, np.split(ids, ends[:-1]), strict=True):
        assert part.tolist() == library.encode(w, add_special_tokens=False).ids, w


def test_documents(spark, library):
    texts = ds.dataset("/root/testdata/sf0.001/documents.parquet").to_table(columns=["text"])["text"].to_pylist()
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "the"), (3, None), (3, "")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    got = sorted(map(str, bpe.digests(df, PATH).collect()))
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        a, b = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
        want.append(f"Row(doc_id={i}, n_tokens={len(ids)}, ids_sha256='{a}', decoded_sha256='{b}')")
    assert got == sorted(want)
    assert bpe.digests(df.limit(0), PATH).count() == 0
