"""A page as a tree of block elements and runs of text.

Inline elements do not make nodes: a run is the text between two block
boundaries.  Reading is linear in the page, whatever stands in it: comments,
scripts and quotes that never close end with the page, and an end tag that
closes nothing is passed over.  Elements nested deeper than ``DEEPEST`` become
siblings at that depth, as in browsers.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

DEEPEST = 512

#: Fixed values of HTML: elements without content, elements whose text is not markup, elements that never hold an article's text, and elements that stand in a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes".split())
SILENT = frozenset("script style textarea title iframe noscript noembed noframes template select button svg canvas audio video object datalist".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr img br input picture source map area output meter progress link meta embed param base center".split()
)
#: What an opening element closes first if it is innermost.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"td", "th", "tr", "p"}, "tbody": {"td", "th", "tr", "thead", "tbody", "p"}, "body": {"head"}}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_SKIP = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"([^\s=>/][^\s=>/]*)(\s*=\s*)?")
_BARE = re.compile(r"[^\s>]*")
_TOKEN = re.compile(r"[a-z]+|[0-9]+")
NAMING = ("class", "id", "role", "itemprop", "aria-label")


@dataclass
class Tree:
    """Nodes in page order: parents before children."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)  # "" for a run of text
    names: list[tuple[str, ...]] = field(default_factory=list)  # lower-case words of naming attributes
    first: list[int] = field(default_factory=list)  # markup place
    last: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)  # characters within links
    links: list[int] = field(default_factory=list)
    controls: list[int] = field(default_factory=list)  # form controls that open directly in a node

    def add(self, parent: int, tag: str, names: tuple[str, ...], at: int, depth: int, text: str = "", linked: int = 0, links: int = 0) -> int:
        for column, value in ((self.parent, parent), (self.depth, depth), (self.tag, tag), (self.names, names), (self.first, at), (self.last, at), (self.text, text), (self.linked, linked), (self.links, links), (self.controls, 0)):
            column.append(value)
        return len(self.parent) - 1


def attributes(page: str, at: int, last_quotes: dict[str, int]) -> tuple[list[tuple[str, str]], int]:
    """Attributes of a tag from ``at``, and the place after its ``>``; -1 if the page ends within the tag."""
    out = []
    while True:
        at = _SKIP.match(page, at).end()
        if at >= len(page):
            return out, -1
        if page[at] == ">":
            return out, at + 1
        m = _ATTRIBUTE.match(page, at)
        if m is None:  # a stray "="
            at += 1
            continue
        at, value = m.end(), ""
        if m[2]:
            quote = page[at : at + 1]
            if quote in ("'", '"') and quote:
                if at >= last_quotes[quote]:
                    return out, -1
                end = page.index(quote, at + 1)
                value, at = page[at + 1 : end], end + 1
            else:
                m2 = _BARE.match(page, at)
                value, at = m2[0], m2.end()
        out.append((m[1].lower(), value))


class _Builder:
    def __init__(self) -> None:
        self.tree = Tree()
        self.stack: list[int] = [self.tree.add(-1, "#page", (), 0, 0)]
        self.open: dict[str, int] = {}
        self.over = 0  # elements beyond DEEPEST that are open
        self.parts: list[str] = []
        self.linked = self.links = 0
        self.link_level = 0  # stack height at which the open link began, or 0

    def flush(self, at: int) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                top = self.stack[-1]
                self.tree.add(top, "", (), at, self.tree.depth[top] + 1, text, min(self.linked, len(text)), self.links)
        self.parts, self.linked, self.links = [], 0, 0

    def words(self, text: str) -> None:
        self.parts.append(text)
        if self.link_level:
            self.linked += len(text)

    def push(self, tag: str, names: tuple[str, ...], at: int) -> None:
        self.flush(at)
        top = self.stack[-1]
        deep = len(self.stack) > DEEPEST
        self.stack.append(self.tree.add(self.tree.parent[top] if deep else top, tag, names, at, self.tree.depth[top] + (not deep)))
        self.open[tag] = self.open.get(tag, 0) + 1

    def pop(self, at: int) -> str:
        self.flush(at)
        node = self.stack.pop()
        self.tree.last[node] = at
        tag = self.tree.tag[node]
        self.open[tag] -= 1
        if self.link_level > len(self.stack):
            self.link_level = 0
        return tag


def parse(page: str) -> Tree:
    b = _Builder()
    n, at = len(page), 0
    last_quotes = {q: page.rfind(q) for q in "'\""}
    silent, silent_open = "", 0  # inside an element without text: its name, and how many of that name are open
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not silent:
            b.words(html.unescape(page[at:lt]))
        if lt >= n:
            break
        following = page[lt + 1 : lt + 2]
        if following == "!" or following == "?":
            if page.startswith("<!--", lt):
                if page.startswith((">", "->"), lt + 4):
                    end = page.index(">", lt + 4) + 1
                else:
                    end = page.find("-->", lt + 4)
                    end = n if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                end = n if end < 0 else end + 1
            at = end
            continue
        closing = following == "/"
        m = _NAME.match(page, lt + 1 + closing)
        if m is None:
            if closing:  # a bogus comment
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                if not silent:
                    b.words("<")
                at = lt + 1
            continue
        tag = m[0].lower()
        if closing:
            end = page.find(">", m.end())
            at = n if end < 0 else end + 1
            if silent:
                if tag == silent:
                    silent_open -= 1
                    if not silent_open:
                        silent = ""
            elif tag in INLINE:
                if tag == "a":
                    b.link_level = 0
            elif b.open.get(tag):
                while b.pop(lt) != tag:
                    pass
            continue
        given, end = attributes(page, m.end(), last_quotes)
        if end < 0:  # the page ends within a tag
            break
        at = end
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(page, at)
            if tag == "textarea" and not silent:
                b.tree.controls[b.stack[-1]] += 1
            if close is None:
                break
            end = page.find(">", close.end())
            at = n if end < 0 else end + 1
            continue
        if silent:
            silent_open += tag == silent
            continue
        if tag in ("input", "select", "button"):
            b.tree.controls[b.stack[-1]] += 1
        if tag in SILENT:
            if not page.startswith("/>", end - 2):
                silent, silent_open = tag, 1
            continue
        if tag in INLINE:
            if tag == "a":
                b.link_level, b.links = len(b.stack), b.links + 1
            elif tag == "br":
                b.parts.append(" ")
            continue
        closes = CLOSES.get(tag, {"p"})
        while len(b.stack) > 1 and b.tree.tag[b.stack[-1]] in closes:
            b.pop(lt)
        if tag in ("html", "body", "head") and b.open.get(tag):
            continue
        if tag in VOID:
            b.flush(lt)
            continue
        names = tuple(w for name, value in given if name in NAMING for w in _TOKEN.findall(value.lower())) if given else ()
        b.push(tag, names, lt)
    while len(b.stack) > 1:
        b.pop(n)
    b.flush(n)
    b.tree.last[0] = n
    return b.tree
