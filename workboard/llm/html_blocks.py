"""Leaf text blocks of an HTML page with what stands above them in the tree."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

# Element kinds of the HTML standard.
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre
search section select summary table tbody td textarea tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
DROPPED = frozenset("script style noscript template iframe svg math head title noembed noframes object audio video canvas".split())
# An opening tag closes an open element of these kinds first.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",), "tbody": ("tr", "td", "th", "tbody", "thead"), "tfoot": ("tr", "td", "th", "tbody", "thead")}
# ... but not beyond these.
SCOPE = frozenset("table ul ol dl select body html menu".split())
LANDMARKS = frozenset("article main nav aside header footer form section".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[\"'>]")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


class Place:
    """An open element, with a link to the one around it: what many blocks share is kept once."""

    __slots__ = ("up", "tag", "names", "depth", "near", "path")

    def __init__(self, up: Place | None, tag: str, names: tuple[str, ...], path: int):
        self.up, self.tag, self.names, self.path = up, tag, names, path
        self.depth: int = 0 if up is None else up.depth + 1
        self.near: str = tag if tag in LANDMARKS else "" if up is None else up.near  # the nearest landmark

    def above(self):
        """This element and those around it, innermost first, without the page itself."""
        at = self
        while at.up is not None:
            yield at
            at = at.up

    @property
    def tags(self) -> tuple[str, ...]:
        return tuple(p.tag for p in self.above())[::-1]


class Block(NamedTuple):
    text: str
    place: Place  # the innermost element that holds it; equal ``path``, equal tags all the way up
    links: int  # characters inside links


def _tag_end(page: str, at: int) -> int:
    """Position behind the ``>`` that ends a tag; quoted values may hold one."""
    first = at
    while m := _STOP.search(page, at):
        if m.group() == ">":
            return m.end()
        close = page.find(m.group(), m.end())
        if close < 0:
            end = page.find(">", first)
            return end + 1 if end >= 0 else len(page)
        at = close + 1
    return len(page)


def blocks(page: str) -> list[Block]:
    """The non-empty leaf blocks of a page, in page order.

    A block is the text between two block-level tags; inline tags vanish, a line
    break is white space. White space becomes one space, references are decoded.
    Comments, scripts, styles and the head are dropped. Broken markup is read
    leniently: unclosed paragraphs end at the next block, unknown closing tags are
    passed over. The time is linear in the page, however deep its elements nest.
    """
    out: list[Block] = []
    stack: list[Place] = [Place(None, "", (), 0)]
    spots: dict[str, list[int]] = {}  # where in the stack each kind is open
    scopes: list[int] = [0]  # where elements that closing does not pass are open
    paths: dict[tuple[int, str], int] = {}
    pieces: list[str] = []
    linked = dropped = links = 0

    def flush():
        nonlocal links
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                out.append(Block(text, stack[-1], min(links, len(text))))
        links = 0

    def push(tag: str, names: tuple[str, ...]):
        nonlocal linked, dropped
        up = stack[-1]
        spots.setdefault(tag, []).append(len(stack))
        if tag in SCOPE:
            scopes.append(len(stack))
        stack.append(Place(up, tag, names, paths.setdefault((up.path, tag), len(paths) + 1)))
        linked += tag == "a"
        dropped += tag in DROPPED

    def pop(to: int):
        nonlocal linked, dropped
        while len(stack) > to:
            tag = stack.pop().tag
            spots[tag].pop()
            if tag in SCOPE:
                scopes.pop()
            linked -= tag == "a"
            dropped -= tag in DROPPED

    def close(kinds) -> None:
        last = max((spots[k][-1] for k in kinds if spots.get(k)), default=0)
        if last > scopes[-1]:
            pop(last)

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not dropped:
            pieces.append(page[at:lt])
            links += (lt - at) * (linked > 0)
        if lt == n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else n
            continue
        m = _TAG.match(page, lt)
        if not m:
            if page[lt + 1: lt + 2] in ("!", "?", "/"):
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else n
            else:
                if not dropped:
                    pieces.append("<")
                at = lt + 1
            continue
        at = _tag_end(page, m.end())
        tag = m.group(2).lower()
        if tag == "br":
            if not dropped:
                pieces.append(" ")
            continue
        if tag in BLOCK:
            flush()
        if m.group(1):
            if spots.get(tag):
                pop(spots[tag][-1])
            continue
        attrs = page[m.end(): at - 1]
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in BLOCK:
            close(("p",))
            if tag in CLOSES:
                for _ in CLOSES[tag]:
                    close(CLOSES[tag])
            if tag == "body":
                close(("head",))
        if tag in RAW:
            end = re.compile(f"</{tag}\\b", re.I).search(page, at)
            stop = end.start() if end else n
            if tag == "textarea" and not dropped:
                push(tag, ())
                pieces.append(page[at:stop])
                flush()
                pop(len(stack) - 1)
            at = _tag_end(page, stop + 2) if end else n
            continue
        own: tuple[str, ...] = ()
        if "=" in attrs:
            own = tuple(w for a in _ATTR.finditer(attrs) for w in _WORD.findall((a.group(2) or a.group(3) or a.group(4) or "").lower()))
        push(tag, own)
    flush()
    return out
