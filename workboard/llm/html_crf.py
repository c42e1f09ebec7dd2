"""Main text of web pages by a linear-chain CRF over DOM leaf blocks.

Each block is main text or not. Emission weights are of features of the ancestor
tags (the nearest landmark among them), the words of their class, id and role and
the text (length, links, marks); transition weights join neighbours. Training maximises
the likelihood of labelled pages, decoding is by Viterbi. The main text is the
blocks labelled main, in page order, joined by line breaks.

Labelled pages: at most SAMPLE pages of the table (smallest hash of id and html; a
documented bound) that mark their article with an element of that kind, have at
most LONGEST characters and nest at most DEEPEST elements; each also lends its blocks to LAYOUTS other pages built from them, in which the same
texts stand in other common layouts (containers named by class only, side bars,
notices, forms, reader comments, adverts inside the article), labelled by how
they were built.

Defined results: null html is empty; a page without blocks has the empty text;
without any labelled page nothing is main text; repeated rows stay, each with its
result, and train once; pages of any length and depth are read whole, in linear time
(a page is one task's work). Extra columns pass through; input columns ``text`` and
``n_chars`` give way to the results.
"""

from __future__ import annotations

import functools
import html
import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workboard.llm.common import hash_sample
from workboard.llm.html_blocks import Block, Place, blocks

SAMPLE = 200
LAYOUTS = 3
LONGEST = 1 << 18
DEEPEST = 100
SIZE = 1 << 14
# Words that notices and page furniture are made of.
CUES = frozenset("""cookie cookies subscribe newsletter login sign share comment comments reply advertisement sponsored
copyright privacy terms menu home search related accept rights reserved posted follow""".split())


def _own(b: Block, before: Block | None) -> list[str]:
    """The features of a block but for those of the elements around it."""
    words = b.text.split()
    f = ["bias", f"parent:{b.place.tag}", f"words:{min(len(words), 255).bit_length()}", f"links:{4 * b.links // len(b.text)}",
         f"ends:{b.text[-1] in '.!?…»”'}", f"commas:{min(b.text.count(','), 7).bit_length()}", f"near:{b.place.near}"]
    if len(words) <= 40:
        f += [f"cue:{w}" for w in {w.strip(".,:!?").lower() for w in words} & CUES]
    if "©" in b.text:
        f.append("copyright")
    if before is not None and before.place.path == b.place.path:
        f.append("same place as before")
    return f


def _around(place: Place) -> list[str]:
    """The features that one element gives to all blocks inside it."""
    return ([] if place.tag in ("html", "body") else [f"in:{place.tag}"]) + [f"name:{w}" for w in place.names]


def features(page: list[Block]) -> list[list[str]]:
    """The features of every block of a page (training; :func:`emissions` scores pages of any depth)."""
    return [[*_own(b, page[i - 1] if i else None), *{f for p in b.place.above() for f in _around(p)}] for i, b in enumerate(page)]


@functools.lru_cache(maxsize=1 << 16)
def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % SIZE


# Training pages.

_OFF = frozenset("nav footer aside form header button select textarea".split())
_OFF_NAMES = frozenset("ad ads advert comment comments share sidebar related promo cookie menu nav footer newsletter".split())


def own_labels(page: list[Block]) -> list[int] | None:
    """Labels of a page that marks its article itself; None if it doesn't."""
    tags = {p.tag for b in page for p in b.place.above()}
    if not tags & {"article", "main"}:
        return None
    mark = "article" if "article" in tags else "main"
    out = []
    for b in page:
        path = b.place.tags
        inside = path[path.index(mark) + 1:] if mark in path else None
        title = inside is not None and path[-1] in ("h1", "h2")
        off = inside is None or (any(t in _OFF for t in inside) and not title)
        out.append(int(not off and not any(_OFF_NAMES.intersection(p.names) for p in b.place.above())))
    return out


def _pick(g, *options: str) -> str:
    return options[int(g.integers(0, len(options)))]


def layout(g, main: list[str], other: list[str]) -> tuple[str, list[int]]:
    """A page of ``main`` paragraphs and ``other`` texts in a random common layout, and its labels."""
    out: list[str] = []
    labels: list[int] = []
    if g.random() < 0.2:  # short articles too
        main = [" ".join(p.split()[: int(g.integers(1, 12))]) for p in main[: int(g.integers(1, 4))]]

    def text(n: int) -> str:
        words = " ".join(other).split() or ["text"]
        at = int(g.integers(0, max(1, len(words) - n)))
        return html.escape(" ".join(words[at: at + n]) or "text")

    def put(tag: str, body: str, label: int) -> None:
        out.append(f"<{tag}>{body}</{tag}>")
        labels.append(label)

    def some(low: int, high: int) -> range:
        return range(int(g.integers(low, high)))

    def menu(tag: str, name: str) -> None:
        out.append(f'<{tag} {name}><ul>')
        for _ in some(3, 9):
            put("li", f'<a href="#">{text(int(g.integers(1, 4)))}</a>', 0)
        out.append(f"</ul></{tag}>")

    def box(tag: str, name: str, low: int = 1, high: int = 4, words: int = 25) -> None:
        out.append(f"<{tag} {name}>")
        for _ in some(low, high):
            put("p", text(int(g.integers(2, words))), 0)
        out.append(f"</{tag}>")

    def form(name: str) -> None:
        out.append(f"<form {name}>")
        put("p", text(int(g.integers(2, 8))), 0)
        out.append('<input name="q">')
        put("button", text(1), 0)
        out.append("</form>")

    def advert() -> None:
        tag = _pick(g, "div", "aside", "section")
        box(tag, f'class="{_pick(g, "ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot")}"', 1, 2, 15)

    def paragraphs(of: list[str]) -> None:
        for i, p in enumerate(of):
            kind = g.random()
            if kind < 0.08:
                put("h2", html.escape(p[:60]), 1)
            elif kind < 0.16:
                out.append("<ul>")
                for part in (p[: len(p) // 2].strip(), p[len(p) // 2:].strip()):
                    if part:
                        put("li", html.escape(part), 1)
                out.append("</ul>")
            elif kind < 0.22:
                out.append("<blockquote>")
                put("p", html.escape(p), 1)
                out.append("</blockquote>")
            else:
                put("p", html.escape(p), 1)
            if g.random() < 0.06:
                advert()

    bare = g.random() < 0.12  # nothing but the article

    def chance(p: float) -> bool:
        return not bare and g.random() < p

    out.append("<html><body>")
    if chance(0.4):
        box("div", f'class="{_pick(g, "cookie-notice", "cookie-banner", "notice", "consent", "alert", "gdpr")}"', 1, 3)
    if chance(0.7):
        top, foot = [("<header>", "</header>"), ('<div class="header">', "</div>"), ('<div id="header">', "</div>"),
                     ('<div class="masthead top">', "</div>")][int(g.integers(0, 4))]
        out.append(top)
        put("div", text(3), 0)
        if g.random() < 0.5:
            menu("nav", "") if g.random() < 0.5 else menu("div", f'class="{_pick(g, "menu", "navbar", "navigation", "nav main-nav", "topbar")}"')
        out.append(foot)
    elif chance(0.6):
        menu("nav", "")
    if chance(0.4):
        form(f'class="{_pick(g, "search", "searchform", "login", "search-box")}"')
    if chance(0.4):
        advert()
    if chance(0.4):
        box(_pick(g, "aside", "div"), f'class="{_pick(g, "sidebar", "side", "sidebar left", "widget", "rail", "related")}"', 2, 6)
    start, end = [("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"),
                  ('<div class="article">', "</div>"), ('<div class="content">', "</div>"), ('<div id="content" class="post">', "</div>"),
                  ('<div class="entry-content">', "</div>"), ('<section class="story body">', "</section>"), ('<div role="main">', "</div>"),
                  ("<div>", "</div>"), ('<div class="post-body text">', "</div>")][int(g.integers(0, 11))]
    out.append(start)
    if g.random() < 0.7 and main:
        put("h1", html.escape(main[0][:70]), 1)
    paragraphs(main)
    if chance(0.3):
        box("div", f'class="{_pick(g, "share", "social", "tags", "author-box", "byline", "meta")}"', 1, 3, 6)
    if chance(0.25):
        form(f'class="{_pick(g, "newsletter", "subscribe", "signup")}"')
    comments = f'{_pick(g, "class", "id")}="{_pick(g, "comments", "comment-list", "responses", "discussion", "comments-area")}"'
    inside = g.random() < 0.2
    if not inside:
        out.append(end)
    if chance(0.5):
        tag = _pick(g, "section", "div", "ol")
        out.append(f"<{tag} {comments}>")
        for _ in some(1, 6):
            own = _pick(g, "div", "li", "article")
            out.append(f'<{own} class="{_pick(g, "comment", "comment-body", "reply")}">')
            for _ in some(1, 3):
                put("p", text(int(g.integers(4, 50))), 0)
            out.append(f"</{own}>")
        out.append(f"</{tag}>")
    if inside:
        out.append(end)
    if chance(0.4):
        box(_pick(g, "aside", "div"), f'class="{_pick(g, "sidebar", "sidebar right", "related", "recommended", "widget", "more")}"', 2, 6)
    if chance(0.75):
        top, foot = [("<footer>", "</footer>"), ('<div class="footer">', "</div>"), ('<div id="footer">', "</div>")][int(g.integers(0, 3))]
        out.append(top)
        for _ in some(1, 4):
            put("p", ("&copy; " if g.random() < 0.5 else "") + text(int(g.integers(2, 15))), 0)
        out.append(foot)
    out.append("</body></html>")
    return "".join(out), labels


def training_pages(pages: list[str], seed: int = 5) -> list[tuple[list[Block], list[int]]]:
    g = np.random.default_rng(seed)
    out = []
    for page in pages:
        read = blocks(page)
        if any(b.place.depth > DEEPEST for b in read):
            continue
        labels = own_labels(read)
        if labels is None or not any(labels):
            continue
        out.append((read, labels))
        main = [b.text for b, y in zip(read, labels) if y]
        other = [b.text for b, y in zip(read, labels) if not y] + main
        for _ in range(LAYOUTS):
            built, wanted = layout(g, main, other)
            again = blocks(built)
            if len(again) == len(wanted):
                out.append((again, wanted))
    return out


# The model.

def _slots(page: list[Block]) -> list[list[int]]:
    return [sorted({_slot(f) for f in fs}) for fs in features(page)]


def train_crf(pages: list[tuple[list[Block], list[int]]], rounds: int = 100, ridge: float = 1e-4) -> dict:
    """Emission weights (main against not), transitions and start scores, by Adam on the likelihood.

    All pages go through the forward and backward sums together, padded to the longest.
    """
    pages = [(b, y) for b, y in pages if b]
    if not pages:
        return {}
    n, width = len(pages), max(len(b) for b, _ in pages)
    y, live = np.zeros((n, width), np.int64), np.zeros((n, width), bool)
    flat, ends, where = [], [0], []
    for i, (b, labels) in enumerate(pages):
        y[i, : len(b)], live[i, : len(b)] = labels, True
        for k, slots in enumerate(_slots(b)):
            flat += slots
            ends.append(len(flat))
            where.append(i * width + k)
    flat, ends, where = np.array(flat), np.array(ends), np.array(where)
    owner = np.repeat(np.arange(len(where)), np.diff(ends))
    p = {"w": np.zeros(SIZE), "tr": np.zeros((2, 2)), "first": np.zeros(2)}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    joint = live[:, 1:]  # a transition into each living block but the first

    def lse(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for step in range(1, rounds + 1):
        e = np.zeros((n, width, 2))
        e.reshape(-1, 2)[where, 1] = np.add.reduceat(p["w"][flat], ends[:-1])
        al, be = np.zeros((n, width, 2)), np.zeros((n, width, 2))
        al[:, 0] = p["first"] + e[:, 0]
        for t in range(1, width):
            al[:, t] = np.where(live[:, t, None], e[:, t] + lse(al[:, t - 1][:, :, None] + p["tr"], 1), al[:, t - 1])
        for t in range(width - 2, -1, -1):
            be[:, t] = np.where(live[:, t + 1, None], lse(p["tr"] + (e[:, t + 1] + be[:, t + 1])[:, None, :], 2), 0.0)
        log_z = lse(al[:, -1], 1)
        mean = np.exp(al + be - log_z[:, None, None])
        pair = np.exp(al[:, :-1, :, None] + p["tr"] + (e[:, 1:] + be[:, 1:])[:, :, None, :] - log_z[:, None, None, None])
        off = (mean[:, :, 1] - y) * live
        g = {"w": np.bincount(flat, off.reshape(-1)[where][owner], SIZE) / n + ridge * p["w"],
             "tr": (pair * joint[:, :, None, None]).sum(axis=(0, 1)), "first": mean[:, 0].sum(axis=0)}
        np.subtract.at(g["tr"], (y[:, :-1][joint], y[:, 1:][joint]), 1.0)
        np.subtract.at(g["first"], y[:, 0], 1.0)
        g["tr"], g["first"] = g["tr"] / n, g["first"] / n
        for k, x in g.items():
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.99 * v[k] + 0.01 * x * x
            p[k] = p[k] - 0.2 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)
    return p


def emissions(page: list[Block], w) -> list[float]:
    """The summed weights of every block's features, each slot once.

    Blocks come in the order of the tree, so that leaving and entering elements from
    one block to the next costs, over the page, a step per element and not per
    element and block.
    """
    inside: dict[int, int] = {}  # slots of the elements around the current block
    total, here, out = 0.0, None, []
    for i, b in enumerate(page):
        enter, leave, there = [], [], b.place
        while here is not there:
            if here is not None and here.depth >= there.depth:
                leave.append(here)
                here = here.up
            else:
                enter.append(there)
                there = there.up
                if there is None:
                    break
        for p in leave:
            for s in {_slot(f) for f in _around(p)} if p.up is not None else ():
                inside[s] -= 1
                if not inside[s]:
                    total -= w[s]
                    del inside[s]
        for p in enter:
            for s in {_slot(f) for f in _around(p)} if p.up is not None else ():
                if s not in inside:
                    total += w[s]
                inside[s] = inside.get(s, 0) + 1
        total = total if inside else 0.0
        here = b.place
        out.append(total + sum(w[s] for s in {_slot(f) for f in _own(b, page[i - 1] if i else None)} if s not in inside))
    return out


def decode(page: list[Block], model: dict) -> list[int]:
    """The best label sequence (Viterbi)."""
    if not model or not page:
        return [0] * len(page)
    w, tr, first = model["w"], model["tr"].tolist(), model["first"].tolist()
    score, back = None, []
    for e in emissions(page, w):
        if score is None:
            score = (first[0], first[1] + e)
            continue
        a = (score[0] + tr[0][0], score[1] + tr[1][0])
        b = (score[0] + tr[0][1], score[1] + tr[1][1])
        back.append((int(a[1] > a[0]), int(b[1] > b[0])))
        score = (max(a), max(b) + e)
    out = [int(score[1] > score[0])]
    for way in reversed(back):
        out.append(way[out[-1]])
    return out[::-1]


def main_text(page: str, model: dict) -> str:
    read = blocks(page)
    return "\n".join(b.text for b, y in zip(read, decode(read, model)) if y)


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> dict:
    """The model, from at most SAMPLE pages of the table that hold an article or main tag."""
    page = F.col(html_col)
    marked = (F.length(page) <= LONGEST) & page.rlike(r"(?i)<(article|main)[\s/>]")
    rows = hash_sample(pages.filter(marked).select(F.col(id_col).alias("i"), page.alias("h")), SAMPLE).collect()
    return train_crf(training_pages([r.h for r in rows]))


def _extractor(model: bytes, at: int):
    def extract(batches):
        m = pickle.loads(model)
        if m:
            m = m | {"w": m["w"].tolist()}
        for batch in batches:
            texts = [main_text(x or "", m) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[c for i, c in enumerate(batch.columns) if i != at], pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                names=[*[c for i, c in enumerate(batch.schema.names) if i != at], "text", "n_chars"])

    return extract


def extract(pages: DataFrame, model: dict, html_col: str = "html") -> DataFrame:
    """All rows of ``pages`` with ``text`` and ``n_chars`` in place of the html."""
    rows = pages.drop("text", "n_chars")
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != html_col],
                           T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(_extractor(pickle.dumps(model), rows.columns.index(html_col)), schema)
