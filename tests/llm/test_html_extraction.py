import random
import re
from html import unescape

import numpy as np

from cladeloom.llm import html_extraction as h


def texts(html):
    return [b.text for b in h.blocks(html)]


def test_blocks_of_odd_markup():
    assert texts(None) == texts("") == texts("<p> </p><!-- x -->") == []
    assert texts("plain &amp; simple") == ["plain & simple"]
    assert texts("<p>a<b>b</b> c<p>d<li>e<li>f</ul>g") == ["ab c", "d", "e", "f", "g"]
    assert texts('<script>var t="</p>";</script><p>x\n\t y&nbsp;z<br>w</p><style>p{}</style>') == ["x y z w"]
    assert texts("<p title='a>b'>q</p><p title=\"never closed>r</p>") == ["q", "r"]
    assert texts("1 < 2 <p>&#233;&eacute;&bogus; &lt;b&gt;</p><!-- open <p>x</p>") == ["1 < 2", "éé&bogus; <b>"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table><textarea>no</textarea>d") == ["a", "b", "c", "d"]
    assert len(texts("<div>" * 5000 + "deep")) == 1
    assert texts("<p>" + "long " * 100_000 + "</p>") == [("long " * 100_000).strip()]


def test_elements_without_an_end_tag():
    for tag in "svg object audio video canvas template noscript".split():
        assert texts(f"<article><p>One.</p><{tag}><p>Two, the body.</p><{tag} x=1><p>Three.</p></article>") == ["One.", "Two, the body.", "Three."], tag
        assert texts(f"<p>One.</p><{tag}><p>no</p></{tag}><p>Two.</p>") == ["One.", "Two."], tag
    assert texts("<p>One.</p><script>var x = '<p>no</p>';") == ["One."]
    assert texts("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p>") == ["Let x=2 be."]
    assert len(texts("<svg><p>a</p>" * 20_000)) == 20_000


def test_every_class_name_counts():
    many = " ".join(f"c{i}" for i in range(40))
    a, b = (h.vectors(h.blocks(f'<div class="{many} {last}">text</div>')) for last in ("banner", "other"))
    assert (a != b).any()


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    m = h.Labeller()
    m.p = {k: v.astype(float) for k, v in m.p.items()}
    x, mask = h.padded([rng.normal(size=(n, h.INPUT)) for n in (1, 4, 6)])
    y = (rng.random(mask.shape) < 0.5).astype(float)

    def loss():
        p = m.probabilities(x, mask)
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    g = m.gradients(x, mask, y)
    for k, v in m.p.items():
        for _ in range(3):
            i = tuple(rng.integers(0, n) for n in v.shape)
            v[i] += 3e-3
            up = loss()
            v[i] -= 6e-3
            assert np.isclose((up - loss()) / 6e-3, g[k][i], atol=2e-4), k
            v[i] += 3e-3


def by_hand(html):
    """The article of the given pages, which mark it."""
    body = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", body)
    parts = [" ".join(unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p))).split()) for p in parts]
    return "\n\n".join(p for p in parts if p)


def test_given_pages_and_other_layouts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    odd = spark.createDataFrame([(None, None, None), (7, "u", ""), (7, "u", "<nav><a>x</a></nav>")], pages.schema)
    model = h.fit(pages)
    rows = {r["page_id"]: r["html"] for r in pages.collect()}
    got = h.extract(pages, model).collect()
    right = sum(r["text"] == by_hand(rows[r["page_id"]]) for r in got)
    assert len(got) == len(rows) and right >= 0.99 * len(rows)
    out = h.extract(odd.withColumnRenamed("url", "text").withColumn("url", odd["page_id"]), model).collect()
    assert len(out) == 3 and out[0]["text"] == out[1]["text"] == ""
    assert h.main_text(pages.limit(0)).count() == 0
    rng = random.Random(91)
    words = ["lorem", "ipsum", "dolor", "sit", "amet,", "et."]
    other = [" ".join(rng.choices(words, k=rng.randint(3, 40))) for _ in range(200)]
    right = total = 0
    for _ in range(200):
        x, y = h.labelled(h.made_page(rng, rng.sample(other, rng.randint(1, 10)), other), True)
        p = model.probabilities(*h.padded([x]))[:, 0] >= 0.5
        right, total = right + (p == y).sum(), total + len(y)
    assert right / total > 0.93
