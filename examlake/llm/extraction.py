"""Main text of web pages by a linear-chain CRF over leaf blocks (operator 5)."""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 1 << 16
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TOKEN = re.compile(r"[a-z]+")
#: Elements by how they shape blocks.
RAW = frozenset("script style title textarea noscript iframe template svg object xmp head-raw".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES |= dict.fromkeys("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split(), {"p"})


@dataclass(slots=True)
class Node:
    tag: str
    up: Node | None
    names: frozenset  # features of this element and all above


@dataclass(slots=True)
class Block:
    text: str
    node: Node
    link_chars: int


def _child(tag: str, attributes: str, up: Node | None) -> Node:
    own = {f"t:{tag}"}
    for m in _NAMES.finditer(attributes):
        value = m[1] or m[2] or m[3] or ""
        own |= {f"c:{x}" for x in _TOKEN.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower())}
    return Node(tag, up, frozenset(own | up.names if up else own))


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order: runs of text between the starts and ends of block elements."""
    root = Node("", None, frozenset())
    node, out, parts, link, anchor = root, [], [], 0, 0

    def flush() -> None:
        nonlocal link
        if parts:
            if text := " ".join("".join(parts).split()):
                out.append(Block(text, node, link))
            parts.clear()
        link = 0

    at, n, lower = 0, len(page), None
    while at < n:
        m = _MARKUP.search(page, at)
        if raw := page[at : m.start() if m else n]:
            shown = entities.unescape(raw) if "&" in raw else raw
            parts.append(shown)
            link += len(shown) if anchor else 0
        if not m:
            break
        at = m.end()
        name, closing, attributes = (m[2], m[1], m[3]) if m[2] else (m[5], m[4], m[6])
        if not name:
            continue
        tag = name.lower()
        if tag == "br":
            parts.append(" ")
        if tag == "a":
            anchor = 0 if closing else 1
        if tag in RAW and not closing and not attributes.rstrip().endswith("/"):
            lower = page.lower() if lower is None or len(lower) != n else lower
            end = lower.find(f"</{tag}", at)
            close = page.find(">", end) if end >= 0 else -1
            at = close + 1 if close >= 0 else n
            continue
        if tag not in BLOCK:
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            up = node
            while up.up is not None and up.tag != tag:
                up = up.up
            node = up.up if up.up is not None else node
        else:
            while node.up is not None and node.tag in CLOSES.get(tag, ()):
                node = node.up
            node = _child(tag, attributes, node)
    flush()
    return out


def _bin(x: float, steps: tuple) -> int:
    return sum(x >= s for s in steps)


class Features:
    """Hashed features of blocks: ancestors' tags and names, and the shape of the text."""

    def __init__(self):
        self.known: dict = {}

    def _ids(self, names) -> list[int]:
        return [self.known.setdefault(x, xxhash.xxh32_intdigest(x.encode()) % DIM) for x in names]

    def of(self, page: list[Block]) -> list[list[int]]:
        if len(self.known) > 200_000:
            self.known.clear()
        out, paths = [], {}
        for i, b in enumerate(page):
            if (own := paths.get(id(b.node))) is None:
                up = b.node.up.tag if b.node.up else ""
                own = paths[id(b.node)] = self._ids([*sorted(b.node.names), f"own:{b.node.tag}", f"two:{up}>{b.node.tag}"])
            n = len(b.text)
            words = b.text.count(" ") + 1
            shape = [
                f"len:{_bin(n, (12, 30, 60, 120, 240, 500))}", f"words:{_bin(words, (2, 4, 8, 16, 40))}", f"link:{_bin(b.link_chars / n, (0.01, 0.3, 0.7))}",
                f"end:{b.text[-1] in '.!?:;'}", f"sign:{any(c in b.text for c in '©|»«·•')}", f"first:{i == 0}", f"last:{i == len(page) - 1}", "bias",
            ]
            out.append(own + self._ids(shape))
        return out


# --- training pages -------------------------------------------------------------------------

#: Usual names of page parts, as (element, attributes), for the labelled layouts.
MAIN = [("article", ""), ("main", ""), ("article", 'class="post"'), ("div", 'class="content"'), ("div", 'id="main-content"'), ("div", 'class="entry-content"'), ("section", 'class="story"'), ("div", 'class="article-body"'), ("div", 'id="post-12"'), ("div", 'role="main"'), ("div", "")]
PARTS = {
    "menu": [("nav", ""), ("div", 'class="menu"'), ("ul", 'class="navigation"'), ("div", 'id="navbar"'), ("div", 'class="breadcrumbs"'), ("div", 'role="navigation"')],
    "header": [("header", ""), ("div", 'class="header"'), ("div", 'id="masthead"'), ("header", 'class="site-header"'), ("div", 'class="banner"')],
    "footer": [("footer", ""), ("div", 'class="footer"'), ("div", 'id="site-footer"'), ("div", 'class="copyright"'), ("div", 'role="contentinfo"')],
    "sidebar": [("aside", ""), ("div", 'class="sidebar"'), ("div", 'id="sidebar-right"'), ("div", 'class="widget"'), ("div", 'class="related"'), ("aside", 'class="recommended"')],
    "notice": [("div", 'class="cookie-notice"'), ("div", 'id="cookies"'), ("div", 'class="notice"'), ("div", 'class="alert"'), ("div", 'class="consent-banner"'), ("div", 'class="gdpr"'), ("div", 'role="alert"'), ("dialog", ""), ("div", 'class="popup modal"')],
    "advert": [("div", 'class="ad"'), ("div", 'class="advert"'), ("div", 'class="ads"'), ("div", 'class="sponsored"'), ("div", 'class="promo"'), ("section", 'class="advertisement"'), ("ins", 'class="adsbygoogle"'), ("div", 'id="ad-slot"')],
    "form": [("form", ""), ("form", 'class="search"'), ("form", 'class="newsletter"'), ("div", 'class="subscribe"'), ("fieldset", ""), ("div", 'class="login signup"')],
    "comments": [("section", 'class="comments"'), ("div", 'id="comments"'), ("ol", 'class="comment-list"'), ("div", 'class="comment"'), ("section", 'id="discussion"'), ("div", 'class="replies"'), ("div", 'class="user-comments"'), ("div", 'id="disqus_thread"'), ("div", 'class="reviews"'), ("div", 'class="respond"')],
    "share": [("div", 'class="share"'), ("ul", 'class="social"'), ("div", 'class="tags"'), ("div", 'class="meta byline"')],
}


def layouts(texts: list[str], others: list[str], seed: int) -> tuple[str, list[int]]:
    """A page with `texts` as its article and sentences of `others` as its other parts, and the blocks' labels."""
    rng = random.Random(seed)
    page, labels = ["<html><head><title>x</title></head><body>"], []
    say = lambda t: entities.escape(t, quote=False)

    def part(kind: str) -> None:
        tag, attributes = rng.choice(PARTS[kind])
        page.append(f"<{tag} {attributes}>" if tag in BLOCK else f"<div {attributes}>")
        menu = kind in ("menu", "share") or rng.random() < 0.2
        for _ in range(rng.randint(2, 7) if menu else rng.randint(1, 4)):
            text = rng.choice(others)
            if menu:
                text = " ".join(text.split()[: rng.randint(1, 3)])
                page.append(f'<li><a href="/x">{say(text)}</a></li>')
            else:
                inner = rng.choice(["p", "p", "div", "li", "h3", "td", "blockquote", "label"] if kind != "comments" else ["p", "p", "p", "div", "li", "h3"])
                page.append(f"<div><{inner}>{say(text)}</{inner}></div>")
            labels.append(0)
        page.append(f"</{tag}>" if tag in BLOCK else "</div>")

    for kind in ("notice", "header", "menu", "advert", "form", "sidebar"):
        if rng.random() < 0.45:
            part(kind)
    wrap = rng.random() < 0.4
    tag, attributes = rng.choice(MAIN)
    page.append('<div class="wrapper container">' * wrap + f"<{tag} {attributes}>")
    for i, text in enumerate(texts):
        inner = "h1" if i == 0 and rng.random() < 0.6 else rng.choice(["p"] * 8 + ["h2", "h3", "li", "blockquote", "pre", "td", "div", "dd", "figcaption"])
        page.append(f"<{inner}>{say(text)}</{inner}>")
        labels.append(1)
        if rng.random() < 0.12:
            part(rng.choice(["advert", "share", "sidebar", "form", "notice"]))
    if rng.random() < 0.2:
        part("comments")
    page.append(f"</{tag}>" + "</div>" * wrap)
    for kind in ("share", "comments", "form", "sidebar", "advert", "notice", "footer"):
        if rng.random() < 0.45:
            part(kind)
    page.append("</body></html>")
    return "".join(page), labels


#: Elements and names (in class, id or role) of parts that are not the article, and names of containers that hold one.
ASIDE = frozenset("t:nav t:header t:footer t:aside t:form t:dialog t:fieldset t:button t:select".split()) | frozenset(
    f"c:{x}"
    for x in "menu nav navigation navbar breadcrumbs masthead banner footer copyright contentinfo sidebar widget related recommended cookie cookies notice alert consent gdpr popup modal ad ads advert advertisement sponsored promo adsbygoogle newsletter subscribe login signup comment comments discussion replies disqus reviews respond share social".split()
)
MARKED = frozenset(("t:article", "t:main", "c:main"))
NAMED = frozenset(f"c:{x}" for x in "article content entry post story".split())


def own_labels(page: list[Block]) -> list[int]:
    """Labels of a page's blocks by how it is built; none is 1 if nothing tells its article.

    The article is what stands in marked containers (article, main), or else in containers named
    for one, or else from the first to the last block of prose (a longer text that ends as a
    sentence, not mostly links); in each case without what stands in other parts of the page.
    """
    free = [not b.node.names & ASIDE for b in page]
    for inside in (MARKED, NAMED):
        labels = [int(f and bool(b.node.names & inside)) for f, b in zip(free, page, strict=True)]
        if any(labels):
            return labels
    prose = [i for i, b in enumerate(page) if free[i] and len(b.text) >= 60 and b.text[-1] in ".!?" and b.link_chars < 0.3 * len(b.text)]
    return [int(f and bool(prose) and prose[0] <= i <= prose[-1]) for i, f in enumerate(free)]


# --- the chain ------------------------------------------------------------------------------


def train_crf(pages: list[tuple[list[list[int]], list[int]]], steps: int = 120, rate: float = 0.3, l2: float = 1e-4) -> dict:
    """Maximum likelihood by full gradients: forward and backward sums run over all pages at once."""
    pages = [p for p in pages if p[1]]
    if not pages:
        return {"w": np.zeros(DIM), "move": np.zeros((2, 2))}
    most = max(len(y) for _, y in pages)
    mask = np.zeros((len(pages), most), bool)
    y = np.zeros((len(pages), most), int)
    flat, owner, at = [], [], []
    for i, (x, labels) in enumerate(pages):
        mask[i, : len(labels)], y[i, : len(labels)] = True, labels
        for t, ids in enumerate(x):
            flat += ids
            owner += [len(at)] * len(ids)
            at.append((i, t))
    flat, owner, at = np.array(flat), np.array(owner), np.array(at)
    w, move = np.zeros(DIM), np.zeros((2, 2))
    gw, gm = np.full(DIM, 1e-8), np.full((2, 2), 1e-8)
    pairs = mask[:, 1:]
    seen = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & pairs).sum() for b in (0, 1)] for a in (0, 1)], float)
    for _ in range(steps):
        e = np.zeros((len(pages), most, 2))
        e[at[:, 0], at[:, 1], 1] = np.bincount(owner, weights=w[flat], minlength=len(at))
        fwd, back = np.zeros_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0]
        for t in range(1, most):
            step = np.logaddexp(fwd[:, t - 1, 0:1] + move[0], fwd[:, t - 1, 1:2] + move[1]) + e[:, t]
            fwd[:, t] = np.where(mask[:, t : t + 1], step, fwd[:, t - 1])
        for t in range(most - 2, -1, -1):
            ahead = back[:, t + 1] + e[:, t + 1]
            step = np.stack([np.logaddexp(ahead[:, 0] + move[a, 0], ahead[:, 1] + move[a, 1]) for a in (0, 1)], axis=1)
            back[:, t] = np.where(mask[:, t + 1 : t + 2], step, 0.0)
        total = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        p1 = np.exp(np.clip(fwd[..., 1] + back[..., 1] - total[:, None], -60, 0))
        g = np.bincount(flat, weights=(y - p1)[at[:, 0], at[:, 1]][owner], minlength=DIM) / len(pages) - l2 * w
        joint = fwd[:, :-1, :, None] + move + (e + back)[:, 1:, None, :] - total[:, None, None, None]
        expected = (np.exp(np.clip(joint, -60, 0)) * pairs[:, :, None, None]).sum(axis=(0, 1))
        h = (seen - expected) / len(pages)
        gw += g * g
        gm += h * h
        w += rate * g / np.sqrt(gw)
        move += rate * h / np.sqrt(gm)
    return {"w": w, "move": move}


def viterbi(model: dict, page: list[list[int]]) -> list[int]:
    """The likeliest labels of a page's blocks; ties go to 'not article'."""
    w, ((a00, a01), (a10, a11)) = model["w"], model["move"].tolist()
    score = [float(w[ids].sum()) for ids in page]
    s0, s1, back = 0.0, score[0] if score else 0.0, []
    for e in score[1:]:
        f0, f1 = s1 + a10 > s0 + a00, s1 + a11 > s0 + a01
        back.append((int(f0), int(f1)))
        s0, s1 = (s1 + a10 if f0 else s0 + a00), (s1 + a11 if f1 else s0 + a01) + e
    state, out = int(s1 > s0), []
    for b in [*reversed(back), None]:
        out.append(state)
        state = b[state] if b else state
    return out[::-1][: len(score)]


def stretches(x: list, n: int) -> list[list]:
    return [x[i : i + n] for i in range(0, len(x), n)]


def training_data(pages: list[list[Block]], variants: int = 4, stretch: int = 200, most: int = 200_000) -> list[tuple[list, list[int]]]:
    """(features, labels) of chains to learn from: the pages as `own_labels` reads them, and layouts made of their texts.

    A page is cut into chains of `stretch` blocks; beyond `most` blocks no further page is taken
    (a part of the sample's bound). For each page's article `variants` layouts set 40 of its blocks
    among other usual page parts. Where no page tells its article, its sentences stand for one.
    """
    features, data, prose, taken = Features(), [], [], 0
    sentences = [s for p in pages for b in p for s in re.split(r"(?<=[.!?])\s+", b.text) if s.strip()]
    for page in pages:
        labels = own_labels(page)
        if any(labels) and taken < most:
            taken += len(page)
            data += zip(stretches(features.of(page), stretch), stretches(labels, stretch), strict=True)
            prose.append([b.text for b, y in zip(page, labels, strict=True) if y])
    for i, texts in enumerate(prose or stretches(sentences[: 40 * len(pages)], 5)):
        parts = stretches(texts, 40)
        for v in range(variants):
            made, labels = layouts(parts[v * len(parts) // variants], sentences, i * 101 + v)
            data.append((features.of(blocks(made)), labels))
    return data


def fit_pages(pages: DataFrame, sample: int = 300, variants: int = 4) -> dict:
    """A CRF trained in one task on up to `sample` pages (the bound, chosen by the hash of page_id; see `training_data`).

    Ids are chosen first, so only the chosen pages' html leaves its task.
    """
    ids = pages.select(F.col("page_id").alias("__id")).distinct().orderBy(F.xxhash64("__id"), "__id").limit(sample)
    chosen = pages.where("html is not null").select("page_id", "html").join(F.broadcast(ids), F.col("page_id").eqNullSafe(F.col("__id")), "left_semi").limit(sample)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        data = training_data([blocks(h) for h in pdf.sort_values(["page_id", "html"])["html"]], variants)
        model = train_crf(data)
        return pd.DataFrame({"w": [model["w"].astype("<f8").tobytes()], "move": [model["move"].astype("<f8").tobytes()], "pages": [len(data)]})

    row = chosen.groupBy(F.lit(1).alias("one")).applyInPandas(fit, "w binary, move binary, pages long").first()
    if row is None:
        return {"w": np.zeros(DIM), "move": np.zeros((2, 2))}
    return {"w": np.frombuffer(row["w"], "<f8"), "move": np.frombuffer(row["move"], "<f8").reshape(2, 2)}


def main_text(pages: DataFrame, model: dict | None = None, sample: int = 300) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks for each row of pages, without a shuffle.

    A null or empty html gives an empty text; so does a page with no article block. Without any
    text to learn from every page is empty. Broken markup is read as far as it goes. Repeated rows give a row each; a null page_id or url stays null.
    """
    shared = pages.sparkSession.sparkContext.broadcast(fit_pages(pages, sample) if model is None else model)
    schema = "page_id long, url string, text string, n_chars long, n_blocks long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, crf = Features(), shared.value
        for batch in batches:
            texts, counts = [], []
            for page in batch.column(2).to_pylist():
                found = blocks(page)
                labels = viterbi(crf, features.of(found)) if found else []
                texts.append("\n".join(b.text for b, y in zip(found, labels, strict=True) if y))
                counts.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64())], ["page_id", "url", "text", "n_chars", "n_blocks"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).mapInArrow(run, schema)
