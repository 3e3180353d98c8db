"""Main-text extraction: a linear-chain CRF over the leaf blocks of a page.

A page is cut into leaf blocks (runs of text between block-level tags). Each block gets features from its
ancestor tags, their class/id words and its own text; a two-label chain (article, other) is decoded by Viterbi.
The model learns from labelled pages: pages of the table whose markup names the article (``<article>``/``<main>``)
give the labels, and each is laid out again in other ways (plain divs, sidebars, notices, forms, comments), so that
the chain doesn't lean on one tag alone.

Defined results: null or empty html, or a page without article blocks, gives an empty text; ties of the two labels
go to "other"; repeated pages are extracted independently; extra columns of the input are ignored.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that the classifier is fitted on at most.
TRAIN_PAGES = 200

# HTML element classes.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe label legend li main menu nav ol option p pre section"
    " select summary table tbody td textarea tfoot th thead title tr ul video audio object".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template textarea svg math iframe object select title".split())
CLOSED_BY = {"p": BLOCK_TAGS - {"body", "html", "head"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
CHROME_TAGS = frozenset("nav header footer aside form dialog menu button".split())
CHROME_WORDS = frozenset(
    "ad ads advert advertisement banner sponsor sponsored promo nav navbar menu breadcrumb breadcrumbs header masthead footer sidebar aside"
    " related share social cookie cookies consent notice notification alert popup modal newsletter subscribe signup login form search"
    " comment comments comentarios respond reply disqus widget pagination pager toc copyright legal".split()
)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Block:
    text: str
    tags: tuple[str, ...]
    words: frozenset[str]
    n_link: int


def blocks_of(page: str | None) -> list[Block]:
    """Leaf blocks of a page in page order, character references decoded, white space inside a block as one space."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []
    parts: list[str] = []
    linked, links = 0, 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(htmllib.unescape("".join(parts)).split())
            if text:
                words = frozenset().union(*(w for _, w in stack)) if stack else frozenset()
                out.append(Block(text, tuple(t for t, _ in stack), words, links))
            parts.clear()
        links = 0

    pos = 0
    while m := _TOKEN.search(page, pos):
        if m.start() > pos:
            parts.append(page[pos : m.start()])
            links += (m.start() - pos) * (linked > 0)
        pos = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag == "br":
            parts.append(" ")
            continue
        if m[1]:
            if tag in BLOCK_TAGS:
                flush()
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if at is not None:
                del stack[at:]
                linked = sum(t == "a" for t, _ in stack)
            continue
        if tag in RAW_TAGS:  # its content isn't markup, and never text of the page
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, pos)
            pos = end.end() if end else len(page)
            if tag in BLOCK_TAGS:
                flush()
            continue
        if tag in BLOCK_TAGS:
            flush()
            for i in range(len(stack) - 1, -1, -1):
                if tag in CLOSED_BY.get(stack[i][0], ()):
                    del stack[i:]
                    break
                if stack[i][0] in BLOCK_TAGS:
                    break
            linked = sum(t == "a" for t, _ in stack)
        if tag not in VOID_TAGS and not m[3].endswith("/"):
            words = frozenset(w for a in _ATTR.findall(m[3]) for w in _WORD.findall("".join(a).lower()))
            stack.append((tag, words))
            linked += tag == "a"
    parts.append(page[pos:])
    flush()
    return out


@lru_cache(maxsize=4096)
def _place(path: tuple[str, ...], words: frozenset[str]) -> list[str]:
    """Features of where a block stands, the same for all blocks under the same ancestors."""
    tags = sorted(set(path))
    f = ["bias", f"leaf={next((t for t in reversed(path) if t in BLOCK_TAGS), 'none')}"]
    f += [f"tag={t}" for t in tags]
    f += [f"chrome-tag={bool(CHROME_TAGS & set(tags))}", f"chrome-word={bool(words & CHROME_WORDS)}"]
    return f + [f"word={w}" for w in sorted(words)]


def features(blocks: list[Block]) -> list[list[str]]:
    out = []
    for i, b in enumerate(blocks):
        n, words = len(b.text), b.text.count(" ") + 1
        f = list(_place(b.tags, b.words))
        share = b.n_link / max(1, n)
        f += [f"links={min(3, int(share * 4))}", f"words={min(7, words.bit_length())}", f"end={b.text[-1] in '.!?:;'}"]
        f += [f"first={i == 0}", f"last={i == len(blocks) - 1}", f"mark={b.text[0] in '©|»«'}"]
        out.append(f)
    return out


@dataclass
class Chain:
    """A two-label chain: one weight per (feature, label) and per (label, label)."""

    index: dict[str, int]
    weight: np.ndarray  # features x 2
    move: np.ndarray  # 2 x 2

    def emissions(self, feats: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(feats), 2))
        for i, f in enumerate(feats):
            ids = [k for x in f if (k := self.index.get(x)) is not None]
            out[i] = self.weight[ids].sum(0)
        return out

    def viterbi(self, feats: list[list[str]]) -> np.ndarray:
        if not feats:
            return np.zeros(0, int)
        e = self.emissions(feats).tolist()
        (stay0, to1), (to0, stay1) = self.move.tolist()
        (a, b), back = e[0], []
        for e0, e1 in e[1:]:
            back.append((int(b + to0 > a + stay0), int(b + stay1 > a + to1)))
            a, b = max(a + stay0, b + to0) + e0, max(a + to1, b + stay1) + e1
        labels = np.zeros(len(e), int)
        labels[-1] = b > a
        for i in range(len(e) - 1, 0, -1):
            labels[i - 1] = back[i - 1][labels[i]]
        return labels


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = 6, rate: float = 0.3, decay: float = 1e-4) -> Chain:
    """Maximum likelihood by stochastic gradient: marginals from forward-backward, pages in a fixed shuffled order."""
    index: dict[str, int] = {}
    for feats, _ in pages:
        for f in feats:
            for x in f:
                index.setdefault(x, len(index))
    chain = Chain(index, np.zeros((len(index), 2)), np.zeros((2, 2)))
    rng = np.random.default_rng(11)
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for k in rng.permutation(len(pages)):
            feats, gold = pages[k]
            if not feats:
                continue
            e, n = chain.emissions(feats), len(feats)
            forward, backward = np.empty((n, 2)), np.zeros((n, 2))
            forward[0] = e[0]
            for i in range(1, n):
                forward[i] = e[i] + _log_sum(forward[i - 1][:, None] + chain.move, 0)
            for i in range(n - 2, -1, -1):
                backward[i] = _log_sum(chain.move + (e[i + 1] + backward[i + 1])[None, :], 1)
            total = _log_sum(forward[-1], 0)
            slope = -np.exp(forward + backward - total)
            slope[np.arange(n), gold] += 1
            for i in range(n):
                chain.weight[[index[x] for x in feats[i]]] += step * slope[i]
            for i in range(1, n):
                pair = forward[i - 1][:, None] + chain.move + (e[i] + backward[i])[None, :] - total
                chain.move -= step * np.exp(pair)
                chain.move[gold[i - 1], gold[i]] += step
        chain.weight *= 1 - decay
    return chain


def weak_labels(blocks: list[Block]) -> list[int] | None:
    """1 for blocks that the page's own markup calls article, outside its menus and adverts; None if it names none."""
    if not any({"article", "main"} & set(b.tags) for b in blocks):
        return None
    return [int(bool({"article", "main"} & set(b.tags)) and not set(b.tags) & CHROME_TAGS and not b.words & CHROME_WORDS) for b in blocks]


def layouts(main: list[str], other: list[str], k: int) -> list[str]:
    """The same article in other page designs, with each kind of page furniture around it."""
    esc = [htmllib.escape(x, quote=False) for x in other] or ["Menu"]
    pick = lambda i: esc[(k + i) % len(esc)][:200]
    body = "".join(f"<p>{htmllib.escape(x, quote=False)}</p>" for x in main)
    nav = "".join(f"<li><a href='/{i}'>{pick(i)[:12]}</a></li>" for i in range(4 + k % 4))
    side = f"<p>{pick(1)}</p><ul>{nav}</ul>"
    note, ad, form, talk, foot = (f"<p>{pick(i)}</p>" for i in range(2, 7))
    kind = ("sidebar", "related", "widget")[k % 3]
    return [
        f"<body><div class='cookie notice'>{note}</div><header><div>{pick(7)}</div><ul class='menu'>{nav}</ul></header><div id='content' class='post'>{body}</div><div class='{kind}'>{side}</div><div class='comments'>{talk}{talk}</div><div class='footer'>{foot}</div></body>",
        f"<body><ul class='nav'>{nav}</ul><main>{body}<div class='advert'>{ad}</div><form><label>{pick(3)}</label>{form}</form></main><aside>{side}</aside><section id='comments'><h3>{pick(4)}</h3>{talk}</section><footer>{foot}</footer></body>",
        f"<body><div class='banner'>{ad}</div>{body}<div class='alert'>{note}</div><div class='newsletter'>{form}</div><footer><div>{foot}</div></footer></body>",
        f"<body><nav>{nav}</nav><article><header><h1>{pick(5)}</h1></header>{body}<aside class='promo'>{ad}</aside><section class='comment-list'>{talk}</section></article><footer>&copy; {pick(6)}</footer></body>",
    ]


def fit(pages: list[str | None]) -> Chain:
    """Train on labelled pages; a page without article markup only lends nothing. No labelled page: the designs alone."""
    labelled = []
    for k, page in enumerate(pages):
        blocks = blocks_of(page)
        gold = weak_labels(blocks)
        if gold is None:
            continue
        labelled.append((features(blocks), gold))
        if k % 4 == 0:
            labelled += _designs([b.text for b, y in zip(blocks, gold, strict=True) if y], [b.text for b, y in zip(blocks, gold, strict=True) if not y], k)
    if not labelled:
        labelled = [x for k in range(8) for x in _designs(["One sentence of an article, written out in full."] * (1 + k), ["Home", "About us", "Read more"], k)]
    return train(labelled)


def _designs(main: list[str], other: list[str], k: int) -> list[tuple[list[list[str]], list[int]]]:
    out, texts = [], {" ".join(x.split()) for x in main}
    for page in layouts(main, other, k):
        blocks = blocks_of(page)
        gold = [int(b.text in texts and not set(b.tags) & CHROME_TAGS and not b.words & CHROME_WORDS) for b in blocks]
        heads = {i for i, b in enumerate(blocks) if b.tags[-2:] == ("header", "h1") and "article" in b.tags}
        out.append((features(blocks), [int(g or i in heads) for i, g in enumerate(gold)]))
    return out


def extract_main_text(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """Article text of every page: page_id, url, text, n_chars, n_blocks, n_main.

    At most `train_pages` pages (those of smallest hashed id) are collected to fit the chain; every page is decoded
    whole, page by page, without a shuffle.
    """
    ids = [r.page_id for r in pages.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(train_pages).collect()]
    sample = pages.where(F.col("page_id").isin(ids)).select("page_id", "html").orderBy("page_id", "html").limit(train_pages).collect()
    chain = fit([r.html for r in sample])

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page in pdf["html"]:
                blocks = blocks_of(page)
                main = [b.text for b, y in zip(blocks, chain.viterbi(features(blocks)), strict=True) if y]
                text = " ".join(main)
                rows.append((text, len(text), len(blocks), len(main)))
            yield pd.concat([pdf[["page_id", "url"]].reset_index(drop=True), pd.DataFrame(rows, columns=["text", "n_chars", "n_blocks", "n_main"])], axis=1)

    return pages.select("page_id", "url", "html").mapInPandas(decode, "page_id long, url string, text string, n_chars long, n_blocks int, n_main int")


def op1_html_extract(spark, sf_dir: str) -> DataFrame:
    from caseworks.llm.common import table

    return extract_main_text(table(spark, sf_dir, "pages"))
