"""Labelled pages for the extractor: random layouts whose article is known.

No table says which parts of a page are its article, so the extractor learns from
pages built here: each draws a layout (semantic elements, named ``div`` s, tables
or bare paragraphs), the blocks around and inside the article, names for them, and
texts of random words.  Words carry no meaning; only the shape and the names of a
page's parts can be learnt.  ``pages(n, seed)`` always gives the same pages.
"""

from __future__ import annotations

import random

from . import dom

MARK = "\ue000"  # stands in the article's texts while a page is built
#: Words that name the parts of a page in class, id and role attributes.
NAMES = {
    "article": "article content post entry story main body text page-content article-body post-content entry-content single hentry story-body prose maincontent primary",
    "wrap": "wrapper container page site layout row col grid inner outer center wrap holder block section panel region box clearfix",
    "nav": "nav navigation menu navbar breadcrumb breadcrumbs topnav mainmenu submenu tabs links pagination pager skip",
    "header": "header masthead top banner site-header logo branding topbar head title-bar",
    "footer": "footer bottom copyright legal colophon site-footer foot imprint",
    "side": "sidebar aside rail widget related recommended popular trending teaser secondary complementary right left more also-read",
    "ad": "ad ads advert advertisement sponsor sponsored promo promoted adsense banner-ad ad-slot commercial partner outbrain",
    "notice": "notice cookie cookies consent gdpr alert message popup modal overlay paywall subscribe-notice warning info disclaimer",
    "form": "form newsletter subscribe signup login search contact register signin mailing",
    "comments": "comments comment commentlist replies reply discussion disqus responses respond thread comment-body reader-comments",
    "share": "share social sharing tools buttons follow actions byline-tools meta tags tagcloud",
}
NAMES = {k: v.split() for k, v in NAMES.items()}
SEMANTIC = {"nav": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}
_LETTERS = "etaoinshrdlucmfwypvbgk"


class _Page:
    def __init__(self, r: random.Random):
        self.r, self.out = r, []
        self.semantic, self.named = r.random() < 0.6, r.random() < 0.75
        self.numbers, self.loud = r.choice((0, 0, 0.02, 0.06)), r.random() < 0.08
        self.noise = r.choice(["", "", "", "###", "%%%", "&amp;&amp;", "***"])
        self.lazy = r.random() < 0.4  # leaves paragraphs and inline elements open

    def words(self, n: int) -> str:
        r = self.r
        ws = ["".join(r.choices(_LETTERS, k=r.choice((1, 2, 3, 4, 5, 6, 8, 11)))) + (self.noise if r.random() < 0.7 else "") for _ in range(max(n, 1))]
        for i in range(len(ws)):
            if r.random() < 0.09:
                ws[i] += r.choice(".,.,.,;:?!")
            if r.random() < self.numbers:
                ws[i] = r.choice((str(r.randrange(2100)), f"{r.randrange(9)}.{r.randrange(9)}", f"{r.randrange(31)}.{r.randrange(12)}.2024"))
        if self.loud and r.random() < 0.5:
            return " ".join(ws).upper()
        ws[0] = ws[0].capitalize()
        return " ".join(ws)

    def sentence(self, n: int) -> str:
        return self.words(n) + self.r.choice((".", ".", ".", "", "?", "!"))

    def mark(self, text: str) -> str:
        """Text with inline elements here and there."""
        r = self.r
        if r.random() < 0.15:
            return f"<b>{text}" + ("" if self.lazy else "</b>") + ("<br>" if r.random() < 0.5 else "")
        if r.random() < 0.15:
            i = text.find(" ", len(text) // 2)
            return text if i < 0 else f'{text[:i]} <a href="/{r.randrange(99)}">{text[i + 1 :]}</a>'
        return text

    def attribute(self, role: str) -> str:
        r = self.r
        if not self.named and role not in ("ad", "comments", "notice", "share", "side"):
            return "" if r.random() < 0.7 else f' class="{r.choice(NAMES["wrap"])}"'
        names = r.sample(NAMES[role], r.choice((1, 1, 2)))
        if r.random() < 0.3:
            names.insert(r.randrange(2), r.choice(NAMES["wrap"]))
        kind = r.choice(("class", "class", "class", "id"))
        return f' {kind}="{" ".join(names)}"' if r.random() < 0.9 else f" {kind}={names[-1]}"

    def block(self, tag: str, inner: str, content: bool = False, attribute: str = "") -> None:
        self.out.append(f"<{tag}{attribute}>{MARK * content}{inner}" + ("" if self.lazy and tag in ("p", "li") and self.r.random() < 0.7 else f"</{tag}>"))

    def opened(self, role: str, tag: str | None = None) -> str:
        tag = tag or (SEMANTIC.get(role, "div") if self.semantic else "div")
        self.out.append(f"<{tag}{self.attribute(role)}>")
        return tag

    def closed(self, tag: str) -> None:
        self.out.append(f"</{tag}>")

    def link(self, n: int) -> str:
        return f'<a href="/{self.r.randrange(999)}">{self.words(n)}</a>'

    def around(self, role: str) -> None:
        """One part of the page that is not its article."""
        r = self.r
        if role == "ad" and r.random() < 0.5:
            self.block("div", self.sentence(r.randrange(2, 40)), attribute=self.attribute("ad"))
            return
        tag = self.opened(role, r.choice(("div", "section", "aside")) if role in ("comments", "notice") and self.semantic else None)
        if role in ("nav", "share"):
            ul = r.random() < 0.8
            self.out.append("<ul>" if ul else "")
            for _ in range(r.randrange(2, 14)):
                self.block("li" if ul else "div", self.link(r.choice((1, 1, 1, 2, 3))))
            self.out.append("</ul>" if ul else "")
        elif role == "header":
            self.block(r.choice(("h1", "div", "p")), self.words(r.randrange(1, 5)))
            if r.random() < 0.5:
                self.block("p", self.sentence(r.randrange(2, 12)))
            if r.random() < 0.4:
                self.around("nav")
        elif role == "footer":
            for _ in range(r.choice((1, 1, 2, 4))):
                self.block(r.choice(("p", "div", "span")) if r.random() < 0.7 else "div", r.choice(("&copy; ", "", "(c) ")) + (self.sentence(r.randrange(2, 25)) if r.random() < 0.6 else self.link(2)))
            if r.random() < 0.3:
                self.out.append(f"&copy; {self.words(3)} &middot; {self.sentence(6)}")
        elif role == "side":
            for _ in range(r.randrange(1, 5)):
                self.block(r.choice(("h2", "h3", "h4")), self.words(r.randrange(1, 5)))
                for _ in range(r.randrange(1, 5)):
                    if r.random() < 0.6:
                        self.block(r.choice(("li", "p", "div")), self.link(r.randrange(2, 12)))
                    else:
                        self.block("p", self.sentence(r.randrange(4, 40)))
        elif role == "ad":
            self.block("p", self.sentence(r.randrange(2, 40)))
            if r.random() < 0.5:
                self.block("p", self.link(3))
        elif role == "notice":
            for _ in range(r.choice((1, 1, 2))):
                self.block("p", self.sentence(r.randrange(4, 45)) + (self.link(2) if r.random() < 0.5 else ""))
            if r.random() < 0.5:
                self.out.append("<button>Ok</button>")
        elif role == "form":
            inner = tag if tag == "form" else self.opened("form", "form")
            if r.random() < 0.6:
                self.block(r.choice(("h3", "p")), self.sentence(r.randrange(2, 20)))
            for _ in range(r.randrange(1, 4)):
                self.block("div", f"<label>{self.words(2)}</label> <input name=q>")
            if inner != tag:
                self.closed(inner)
        elif role == "comments":
            self.block(r.choice(("h2", "h3", "h4", "p")), self.words(2))
            for _ in range(r.randrange(1, 8)):
                each = self.opened("comments", r.choice(("div", "li", "article") if self.semantic else ("div", "li")))
                if r.random() < 0.7:
                    self.block(r.choice(("div", "p", "h4")), self.words(2) + (f" {r.randrange(1, 28)}.{r.randrange(1, 12)}.2024" if r.random() < 0.5 else ""))
                for _ in range(r.choice((1, 1, 2, 3))):
                    self.block("p", self.mark(self.sentence(r.randrange(1, 70))))
                self.closed(each)
        self.closed(tag)

    def article(self) -> None:
        r = self.r
        tag = self.opened("article", (r.choice(("article", "article", "main", "section")) if self.semantic else r.choice(("div", "div", "td"))))
        table = tag == "td"
        if table:
            self.out[-1] = "<table><tr>" + self.out[-1]
        inner = self.opened("wrap" if r.random() < 0.5 else "article", "div") if r.random() < 0.35 else ""
        if r.random() < 0.85:
            self.block(r.choice(("h1", "h1", "h2")), self.words(r.randrange(1, 14)), True)
        size = r.choice((1, 2, 6, 12, 30, 80, 160))
        for _ in range(r.choice((1, 2, 3, 5, 8, 13, 25))):
            what = r.random()
            if what < 0.72:
                self.block("p", self.mark(self.sentence(r.randrange(1, 2 * size + 1))), True)
            elif what < 0.78:
                self.block(r.choice(("h2", "h3")), self.words(r.randrange(1, 9)), True)
            elif what < 0.83:
                kind = r.choice(("ul", "ol"))
                self.out.append(f"<{kind}>")
                for _ in range(r.randrange(2, 7)):
                    self.block("li", self.mark(self.sentence(r.randrange(1, 25))), True)
                self.out.append(f"</{kind}>")
            elif what < 0.87:
                self.out.append("<blockquote>")
                self.block("p", self.sentence(r.randrange(3, 60)), True)
                self.out.append("</blockquote>")
            elif what < 0.89:
                self.out.append("<table>")
                for _ in range(r.randrange(2, 5)):
                    self.out.append("<tr>")
                    for _ in range(3):
                        self.block("td", self.words(r.randrange(1, 4)), True)
                    self.out.append("</tr>")
                self.out.append("</table>")
            elif what < 0.92:
                self.block("pre", self.words(r.randrange(2, 30)), True)
            elif what < 0.95 and not self.lazy:
                self.out.append(MARK + self.sentence(r.randrange(2, size + 3)))
                self.out.append("<hr>")
            else:
                self.around(r.choice(("ad", "ad", "side", "notice", "share", "form")))
        if r.random() < 0.15:
            self.around("comments")
        if inner:
            self.closed(inner)
        self.closed(tag)
        if table:
            self.out.append("</tr></table>")

    def whole(self) -> str:
        r = self.r
        self.out.append(f"<!DOCTYPE html><html><head><title>{self.words(4)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>")
        if r.random() < 0.06:  # bare paragraphs, or nothing but text
            if r.random() < 0.3:
                self.out.append(MARK + self.sentence(r.randrange(5, 120)))
            else:
                for _ in range(r.randrange(1, 12)):
                    self.block("p", self.mark(self.sentence(r.randrange(1, 80))), True)
            return "".join(self.out)
        wrap = self.opened("wrap", "div") if r.random() < 0.5 else ""
        chance = {"notice": 0.2, "header": 0.5, "nav": 0.8, "ad": 0.4, "form": 0.15, "side": 0.25}
        for role, p in chance.items():
            if r.random() < p:
                self.around(role)
        middle = self.opened("wrap", "div") if r.random() < 0.3 else ""
        self.article()
        chance = {"share": 0.2, "ad": 0.2, "comments": 0.35, "side": 0.35}
        for role, p in chance.items():
            if r.random() < p:
                self.around(role)
        if middle:
            self.closed(middle)
        chance = {"comments": 0.1, "form": 0.2, "nav": 0.2, "footer": 0.8, "notice": 0.15}
        for role, p in chance.items():
            if r.random() < p:
                self.around(role)
        if wrap:
            self.closed(wrap)
        return "".join(self.out) + ("</body></html>" if r.random() < 0.9 else "")


def pages(n: int, seed: int) -> list[tuple[str, list[bool]]]:
    """n pages, each with whether its runs of text, in page order, belong to the article."""
    made = []
    for i in range(n):
        marked = _Page(random.Random(seed * 1_000_003 + i)).whole()
        made.append((marked.replace(MARK, ""), [MARK in t for t in dom.parse(marked).text if t]))
    return made
