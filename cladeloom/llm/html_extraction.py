"""Main text of web pages: a bidirectional LSTM labels every block of a page."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import escape, unescape
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import hashed_sample

SAMPLE = 300  # pages that the labeller is fitted on, at most, none over SAMPLE_BYTES
SAMPLE_BYTES = 100_000
MADE = 900  # pages made from their text in other layouts
PATH, NEAR, WORDS, NUMBERS = 64, 32, 32, 8  # hashed path, hashed inner tags, hashed words, numbers
INPUT = PATH + NEAR + WORDS + NUMBERS
HIDDEN = 16
EPOCHS, BATCH, RATE = 6, 32, 6e-3
STEPS_AT_ONCE = 20_000  # blocks, padding included, that are labelled at once

# HTML elements by what they do to text.
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul search legend optgroup option".split()
)
UNSEEN = set("script style title textarea noscript template iframe svg head object canvas audio video noframes xmp noembed".split())
RAW = set("script style title textarea iframe noframes xmp noembed".split())  # hold no elements: without an end tag they run to the end of the page
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEADING = set("h1 h2 h3 h4 h5 h6".split())
# An opening tag closes an open element of these names, up to the nearest element in which it is nested.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NESTED = set("ul ol menu dl table select article section main aside nav div body td th blockquote form".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+|[^>]*)>|<[!?/][^>]*>", re.S)
_NAMES = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PIECES = re.compile(r"[a-z]+|\d+")


class Block(NamedTuple):
    text: str
    path: tuple[int, ...]  # hashes of the tags and names of all open elements
    near: tuple[int, ...]  # of the two innermost ones
    linked: int  # characters inside links
    heading: bool
    main: bool | None  # inside an article or main element, outside navigation and the like; None: the page has neither


@lru_cache(4096)
def _hashes(tag: str, names: tuple[str, ...]) -> tuple[int, ...]:
    return tuple(crc32(x.encode()) for x in (f"<{tag}", *(f".{n}" for n in names)))


@lru_cache(64)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I)


# Elements and name pieces that mark what is not the article.
_ASIDE = set("nav header footer aside form menu search dialog".split())
_ASIDE_NAMES = set("ad ads advert advertisement banner sponsor sponsored promo cookie consent notice comment comments reply share social related sidebar".split())


def blocks(html: str | None) -> list[Block]:
    """The visible blocks of a page in order: character references decoded, white space folded to one space, none empty."""
    html = html or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[int, ...], bool]] = []
    text: list[str] = []
    linked = links = 0
    inside_main = bool(re.search(r"<(?:article|main)\b", html, re.I))
    unclosed: set[str] = set()

    def settle() -> None:
        nonlocal linked
        if text:
            joined = " ".join(unescape("".join(text)).split())
            if joined:
                path = tuple(h for _, hs, _ in stack for h in hs)
                near = tuple(h for _, hs, _ in stack[-2:] for h in hs)
                main = any(t in ("article", "main") for t, _, _ in stack) and not any(a for _, _, a in stack) if inside_main else None
                out.append(Block(joined, path, near, linked, bool(stack) and any(t in HEADING for t, _, _ in stack), main))
            text.clear()
        linked = 0

    def close(upto: int) -> None:
        nonlocal links
        links -= sum(t == "a" for t, _, _ in stack[upto:])
        del stack[upto:]

    at = 0
    while True:
        m = _TOKEN.search(html, at)
        piece = html[at : m.start() if m else len(html)]
        if piece:
            text.append(piece)
            if links:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                settle()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if stack[k][0] in NESTED and tag not in BLOCK:
                    break
            continue
        if tag in UNSEEN and tag != "head":
            end = _end_of(tag).search(html, at) if not m[3].endswith("/") and tag not in unclosed else None
            if end:
                at = end.end()
            elif not m[3].endswith("/"):
                if tag in RAW:
                    at = len(html)
                unclosed.add(tag)  # no end tag follows: what comes after belongs to the page
            text.append(" ")
            continue
        if tag == "br":
            text.append(" ")
        if tag in VOID:
            if tag in BLOCK:
                settle()
            continue
        if tag in BLOCK:
            settle()
            shut = CLOSES.get(tag, {"p"} | (HEADING if tag in HEADING else set()))
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in shut:
                    close(k)
                    break
                if stack[k][0] in NESTED:
                    break
        names = tuple(p for x in _NAMES.findall(m[3]) for p in _PIECES.findall("".join(x).lower())) if m[3] else ()
        aside = (tag in _ASIDE and not (tag == "header" and any(t in ("article", "main") for t, _, _ in stack))) or not _ASIDE_NAMES.isdisjoint(names)
        stack.append((tag, _hashes(tag, names), aside))
        links += tag == "a"
    settle()
    return out


def vectors(page: list[Block]) -> np.ndarray:
    """One row of inputs for each block: hashed tag path, hashed inner tags, hashed words, and numbers of size, links and marks."""
    x = np.zeros((len(page), INPUT), np.float32)
    for i, b in enumerate(page):
        row = x[i]
        for h in b.path:
            row[h % PATH] += 1 if h >> 16 & 1 else -1
        for h in b.near:
            row[PATH + h % NEAR] += 1 if h >> 16 & 1 else -1
        words = b.text.split(" ")
        hashed = np.bincount([crc32(w.encode()) % WORDS for w in words], minlength=WORDS)
        row[PATH + NEAR : PATH + NEAR + WORDS] = hashed / len(words) ** 0.5
        n = len(b.text)
        row[-NUMBERS:] = (
            np.log1p(n) / 3 - 1, np.log1p(len(words)) / 2 - 1, min(1, b.linked / n), sum(map(b.text.count, ".,;!?")) / n * 10,
            b.heading, i / len(page), len(b.path) / 10, np.log1p(len(page)) / 3 - 1,
        )
    return np.clip(x, -3, 3)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM over the blocks of a page with a logistic label for each block."""

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p["W" + d] = (rng.normal(size=(INPUT, 4 * HIDDEN)) * INPUT**-0.5).astype(np.float32)
            self.p["R" + d] = (rng.normal(size=(HIDDEN, 4 * HIDDEN)) * HIDDEN**-0.5).astype(np.float32)
            self.p["c" + d] = np.repeat(np.float32([0, 1, 0, 0]), HIDDEN)
        self.p["o"] = (rng.normal(size=2 * HIDDEN) * 0.2).astype(np.float32)
        self.p["s"] = np.zeros(1, np.float32)

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        """x: steps x pages x inputs. Padding leaves the state as it is."""
        steps, pages, _ = x.shape
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        out, kept = np.zeros((steps, pages, HIDDEN), np.float32), []
        pre = x @ self.p["W" + d] + self.p["c" + d]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = pre[t] + h @ self.p["R" + d]
            i, f, o = (_sigmoid(a[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(a[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            tc = np.tanh(new)
            kept.append((t, h, c, i, f, o, g, tc, m))
            h, c = np.where(m, o * tc, h), np.where(m, new, c)
            out[t] = h
        return out, kept

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(d, x, mask)[0] for d in "fb"], axis=2)
        return _sigmoid(both @ self.p["o"] + self.p["s"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {d: self._run(d, x, mask) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        e = (_sigmoid(both @ self.p["o"] + self.p["s"]) - y) * mask / mask.sum()
        g = {"o": np.einsum("tp,tph->h", e, both), "s": e.sum(keepdims=True)[0]}
        for k, d in enumerate("fb"):
            R = self.p["R" + d]
            dpre = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dR = np.zeros_like(R)
            dh = np.zeros((x.shape[1], HIDDEN), np.float32)
            dc = np.zeros_like(dh)
            for t, h, c, i, f, o, gg, tc, m in reversed(runs[d][1]):
                dh = dh + e[t][:, None] * self.p["o"][k * HIDDEN : (k + 1) * HIDDEN]
                dnew = np.where(m, dc + dh * o * (1 - tc**2), 0)
                da = np.concatenate((dnew * gg * i * (1 - i), dnew * c * f * (1 - f), np.where(m, dh * tc * o * (1 - o), 0), dnew * i * (1 - gg**2)), axis=1)
                dpre[t] = da
                dR += h.T @ da
                dh = np.where(m, 0, dh) + da @ R.T
                dc = np.where(m, dnew * f, dc)
            g["W" + d] = np.einsum("tpi,tpg->ig", x, dpre, optimize=True)
            g["R" + d], g["c" + d] = dR, dpre.sum(axis=(0, 1))
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], seed: int = 3) -> None:
        rng, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for epoch in range(EPOCHS):
            order = sorted(range(len(pages)), key=lambda i: (len(pages[i][0]) // 16, rng.random()))
            batches = [order[a : a + BATCH] for a in range(0, len(order), BATCH)]
            rng.shuffle(batches)
            for own in batches:
                x, mask = padded([pages[i][0] for i in own])
                y = np.zeros(mask.shape, np.float32)
                for k, i in enumerate(own):
                    y[: len(pages[i][1]), k] = pages[i][1]
                g = self.gradients(x, mask, y)
                step += 1
                norm = max(1.0, float(np.sqrt(sum((v**2).sum() for v in g.values()))))
                rate = RATE * (1 - epoch / EPOCHS) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                for k, w in self.p.items():
                    m[k] += 0.1 * (g[k] / norm - m[k])
                    s[k] += 0.001 * ((g[k] / norm) ** 2 - s[k])
                    w -= rate * m[k] / (np.sqrt(s[k]) + 1e-8)

    def main_blocks(self, pages: list[list[Block]]) -> list[list[str]]:
        """The texts of the main blocks of each page."""
        out: list[list[str]] = [[] for _ in pages]
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        while order:
            n = 1
            while n < len(order) and (n + 1) * len(pages[order[n]]) <= STEPS_AT_ONCE:
                n += 1
            own, order = order[:n], order[n:]
            p = self.probabilities(*padded([vectors(pages[i]) for i in own]))
            for k, i in enumerate(own):
                out[i] = [b.text for b, q in zip(pages[i], p[:, k], strict=False) if q >= 0.5]
        return out


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, rows))
    x, mask = np.zeros((steps, len(rows), INPUT), np.float32), np.zeros((steps, len(rows)), bool)
    for k, r in enumerate(rows):
        x[: len(r), k], mask[: len(r), k] = r, True
    return x, mask


# Names that page makers give to parts of a page.
_MAIN = ["content", "post", "entry", "article", "article-body", "story", "text", "main", "body", "post-content", "entry-content", "page"]
_OFF = {
    "menu": ["menu", "nav", "navbar", "breadcrumb", "topnav", "links", "tabs", "pagination"],
    "header": ["header", "masthead", "top", "logo", "branding", "site-header"],
    "footer": ["footer", "bottom", "copyright", "site-footer", "legal"],
    "side": ["sidebar", "aside", "widget", "related", "recommended", "popular", "trending", "tags"],
    "notice": ["cookie", "consent", "notice", "banner", "alert", "gdpr", "popup", "modal", "newsletter", "paywall"],
    "ad": ["ad", "ads", "advert", "sponsored", "promo", "promotion", "banner-ad", "advertisement"],
    "form": ["search", "login", "subscribe", "signup", "contact", "search-form"],
    "comments": ["comments", "comment-list", "responses", "disqus", "replies", "discussion"],
    "share": ["share", "social", "byline", "meta", "tools"],
}
_TAG = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form", "comments": "section"}


def made_page(rng: random.Random, body: list[str], other: list[str]) -> str:
    """A page of another layout: the paragraphs `body` as the article, sentences of `other` around and between them."""
    some = lambda n: escape(" ".join(rng.choice(other).split(" ")[: rng.randint(1, n)]))
    blank = rng.random() < 0.15  # a page whose parts have no telling names

    def wrap(kind: str, inner: str) -> str:
        tag = _TAG.get(kind, "div") if rng.random() < 0.5 else rng.choice(["div", "section", "div"])
        name = "" if blank or (tag == _TAG.get(kind) and rng.random() < 0.5) else f' {rng.choice(["class", "id"])}="{rng.choice(_OFF[kind])}"'
        return f"<{tag}{name}>{inner}</{tag}>"

    def part(kind: str) -> str:
        if kind == "menu":
            return wrap(kind, "<ul>" + "".join(f'<li><a href="/{i}">{some(2)}</a></li>' for i in range(rng.randint(2, 9))) + "</ul>")
        if kind == "header":
            return wrap(kind, f'<a href="/">{some(3)}</a>' + (f"<h1>{some(4)}</h1>" if rng.random() < 0.3 else f"<p>{some(8)}</p>"))
        if kind == "side":
            return wrap(kind, f"<h{(k := rng.randint(2, 4))}>{some(3)}</h{k}>" + "".join(f'<p><a href="/{i}">{some(9)}</a></p>' for i in range(rng.randint(1, 5))) + (f"<p>{some(30)}</p>" if rng.random() < 0.4 else ""))
        if kind == "form":
            return wrap(kind, f"<label>{some(3)}</label><input name=q><button>{some(2)}</button>" + (f"<p>{some(15)}</p>" if rng.random() < 0.4 else ""))
        if kind == "comments":
            inner = "".join(f'<div class="comment"><b>{some(2)}</b><p>{some(40)}</p></div>' if rng.random() < 0.7 else f"<li><p>{some(40)}</p></li>" for _ in range(rng.randint(1, 6)))
            return wrap(kind, f"<h3>{some(3)}</h3>" + inner)
        if kind == "footer":
            return wrap(kind, rng.choice(["&copy; ", "&copy; 2020 ", ""]) + f"{some(4)} &middot; {some(12)}")
        if kind == "share":
            return wrap(kind, "".join(f'<a href="#">{some(1)}</a> ' for _ in range(rng.randint(1, 4))))
        return wrap(kind, some(25) if rng.random() < 0.5 else f"<p>{some(25)}</p>")

    inner = []
    if rng.random() < 0.7:
        inner.append(f"<h1>{some(12)}</h1>")
    for k, p in enumerate(body):
        tag = rng.choice(["p"] * 14 + ["h2", "blockquote", "li", "pre", "div", "td"])
        text = escape(p)
        if rng.random() < 0.2:
            words = text.split(" ")
            at = rng.randrange(len(words))
            words[at] = rng.choice([f'<a href="/x">{words[at]}</a>', f"<b>{words[at]}</b>", f"<em>{words[at]}</em>"])
            text = " ".join(words)
        inner.append({"li": f"<ul><li>{text}</li></ul>", "td": f"<table><tr><td>{text}</td></tr></table>"}.get(tag, f"<{tag}>{text}</{tag}>" if tag != "p" or rng.random() < 0.9 else f"<p><b>{text}<br>"))
        if rng.random() < 0.06:
            inner.append(part(rng.choice(["ad", "share", "side", "notice", "form"])))
    tag = rng.choice(["article", "article", "main", "div", "div", "section"])
    name = f' class="{rng.choice(_MAIN)}"' if tag in ("div", "section") or rng.random() < 0.3 else ""
    article = f"<{tag}{name}>" + "".join(inner) + f"</{tag}>"
    before = [part(k) for k in ("notice", "header", "menu", "ad", "form", "side") if rng.random() < 0.45]
    after = [part(k) for k in ("share", "side", "comments", "ad", "form", "notice", "menu") if rng.random() < 0.35]
    rng.shuffle(before)
    rng.shuffle(after)
    if rng.random() < 0.9:
        after.append(part("footer"))
    page = "".join(before) + f"\0{article}\0" + "".join(after)
    return f"<html><head><title>{some(6)}</title></head><body>" + (f'<div class="wrap">{page}</div>' if rng.random() < 0.4 else page) + "</body></html>"


def labelled(page: str, marked: bool) -> tuple[np.ndarray, np.ndarray] | None:
    """Inputs and labels of a page: of a made one from the marks around its article and the names of the parts in it, else from its tags."""
    if not marked:
        own = blocks(page)
        return (vectors(own), np.array([b.main for b in own], np.float32)) if own and own[0].main is not None else None
    before, article, after = page.split("\0")
    whole = blocks(before + article + after)
    head = len(blocks(before))
    inner = blocks("<article>" + article + "</article>")
    y = np.zeros(len(whole), np.float32)
    y[head : head + len(inner)] = [b.main for b in inner]
    return vectors(whole), y


def fit(pages: DataFrame, sample: int = SAMPLE) -> Labeller:
    """A labeller fitted on at most `sample` pages and MADE pages made from their text.

    No labels are given. The sampled pages (those whose page_id hashes lowest, up to SAMPLE_BYTES each) label their own blocks
    where they mark an article; their paragraphs then fill pages of many other layouts, whose article is known.
    Without pages the text is made up.
    """
    rows = pages.where(F.octet_length("html") <= SAMPLE_BYTES).select("page_id", F.col("html").cast("string").alias("html"))
    own = sorted(r["html"] for r in hashed_sample(rows, ["page_id", "html"], sample).collect())
    rng = random.Random(17)
    parsed = [blocks(h) for h in own]
    articles = [a for p in parsed if (a := [b.text for b in p if b.main is not False and len(b.text) > 20])]
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(1, 9))) for _ in range(500)]
    articles += [[" ".join(rng.choices(words, k=rng.randint(5, 60))) + "." for _ in range(rng.randint(1, 12))] for _ in range(max(20, 100 - len(articles)))]
    other = [t for a in articles for t in a]
    train = [x for h in own if (x := labelled(h, False))]
    for _ in range(MADE):
        body = rng.choice(articles)
        at = rng.randrange(len(body))
        train.append(labelled(made_page(rng, body[at : at + rng.randint(1, 14)], other), True))
    model = Labeller()
    model.fit(train)
    return model


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """(page_id, url, text, n_blocks, n_main) of every page row: the main blocks in order, joined by an empty line.

    A null, empty or blockless page gives an empty text. Repeated rows and null ids stay rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                parsed = [blocks(h) for h in part.column(2).to_pylist()]
                main = model.main_blocks(parsed)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array(["\n\n".join(t) for t in main], pa.string()),
                        pa.array([len(p) for p in parsed], pa.int32()), pa.array([len(t) for t in main], pa.int32()),
                    ],
                    ["page_id", "url", "text", "n_blocks", "n_main"],
                )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_blocks int, n_main int")


def main_text(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    out = extract(pages, fit(pages, sample))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_blocks", "n_main")
