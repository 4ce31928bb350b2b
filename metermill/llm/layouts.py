"""Page layouts with known parts, to train the extraction of main texts: texts of real pages in other templates.

``data-truth`` marks what an element is: c for the article, b for anything around or inside it that is not.  Elements without a mark are
like their parent; containers above the article are neither.
"""

from __future__ import annotations

import html
import random

CONTENT_NAMES = "article content post entry story main body text article-body entry-content post-body story-text main-content page-content blog-post body-copy prose articleBody post-content".split()
NEUTRAL_NAMES = "box wrap wrapper container row col inner block section module c1 x7 grid layout page site app root view outer area zone part unit s12 g-3 clearfix left right center".split()
PART_NAMES = {
    "nav": "nav navbar main-menu menu topnav breadcrumbs breadcrumb navigation site-nav pagination toc".split(),
    "head": "header site-header masthead topbar page-header banner branding logo".split(),
    "foot": "footer site-footer page-footer bottom copyright legal colophon footer-links".split(),
    "side": "sidebar side right-rail widget related related-posts recommended trending popular-posts teasers read-more rail".split(),
    "notice": "cookie-notice cookie-banner consent gdpr notice alert popup modal overlay newsletter subscribe-box privacy-notice paywall".split(),
    "ad": "ad ads advert advertisement ad-slot sponsored promo adbox ad-container sponsor banner-ad".split(),
    "form": "search search-form contact-form login signup-form form".split(),
    "comment": "comments comment-list comment-section discussion responses replies respond user-comments reader-comments".split(),
    "share": "share share-bar social social-links byline post-meta tags author-box meta".split(),
}
PART_TAGS = {"nav": ["nav"], "head": ["header"], "foot": ["footer"], "side": ["aside"], "notice": ["dialog", "aside", "section"], "ad": ["ins", "aside"], "form": ["form"], "comment": ["section"], "share": ["p", "ul"]}
NOTICE = ["We use cookies to improve this site. By going on you accept this.", "This site uses cookies.", "Please accept our terms to go on reading.", "Subscribe now and read on for free.", "Diese Seite verwendet Cookies.", "Nous utilisons des cookies."]


class Layout:
    def __init__(self, rng: random.Random, phrases: list[str]):
        self.rng, self.phrases = rng, phrases or ["word"]
        self.space = rng.choice(["", "", "\n", "\n  "])
        self.upper = rng.random() < 0.05
        self.unclosed = rng.random() < 0.1

    def el(self, tag: str, inner: str, truth: str = "", names: list[str] = (), closed: bool = True) -> str:
        r = self.rng
        tag = tag.upper() if self.upper else tag
        attrs = ""
        if names:
            where = r.choice(["class", "class", "class", "id", "role" if r.random() < 0.1 else "class"])
            attrs = f" {where}=" + (names[0] if len(names) == 1 and r.random() < 0.1 else '"' + " ".join(names) + '"')
        if truth:
            attrs += f" data-truth={truth}"
        return f"{self.space}<{tag}{attrs}>{inner}" + (f"</{tag}>" if closed else "")

    def some(self, names: list[str], most: int = 1) -> list[str]:
        return self.rng.sample(names, min(len(names), self.rng.randint(1, most)))

    def named(self, kind: str) -> tuple[str, list[str]]:
        """Element and names of a part: of a telling kind, or telling names, rarely neither."""
        r = self.rng
        telling = r.random()
        tag = r.choice(PART_TAGS[kind]) if telling < 0.45 else r.choice(["div", "div", "div", "section", "ul" if kind == "nav" else "div"])
        names = self.some(PART_NAMES[kind], 2) if telling > 0.3 and telling < 0.94 else (self.some(NEUTRAL_NAMES) if r.random() < 0.5 else [])
        if names and r.random() < 0.2:
            names = names + self.some(NEUTRAL_NAMES)
        return tag, names

    def words(self, low: int, high: int) -> str:
        words = self.rng.choice(self.phrases).split() or ["word"]
        n = self.rng.randint(low, high)
        at = self.rng.randrange(max(1, len(words) - n + 1))
        return html.escape(" ".join(words[at : at + n]), quote=False)

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.rng.randrange(999)}">{self.words(low, high)}</a>'

    def links(self, low: int, high: int) -> str:
        r = self.rng
        found = [self.link() for _ in range(r.randint(low, high))]
        if r.random() < 0.6:
            return self.el("ul", "".join(self.el("li", a, closed=r.random() > 0.1) for a in found))
        return r.choice([" ", " | ", " "]).join(found)

    def part(self, kind: str, inner: str) -> str:
        tag, names = self.named(kind)
        return self.el(tag, inner, "b", names)

    def nav(self) -> str:
        return self.part("nav", self.links(2, 9))

    def head(self) -> str:
        inner = self.el(self.rng.choice(["div", "a", "h1", "p"]), self.words(1, 4)) + (self.el("p", self.words(2, 8)) if self.rng.random() < 0.4 else "")
        return self.part("head", inner + (self.nav() if self.rng.random() < 0.5 else ""))

    def foot(self) -> str:
        r = self.rng
        inner = ("&copy; " if r.random() < 0.7 else "") + self.words(2, 20)
        inner = self.el("p", inner) if r.random() < 0.5 else inner
        return self.part("foot", inner + (self.links(2, 6) if r.random() < 0.4 else "") + (self.el("p", self.words(3, 20)) if r.random() < 0.3 else ""))

    def side(self) -> str:
        r = self.rng
        out = ""
        for _ in range(r.randint(1, 3)):
            box = self.el(r.choice(["h2", "h3", "h4", "b"]), self.words(1, 3)) if r.random() < 0.6 else ""
            box += self.links(2, 6) if r.random() < 0.6 else "".join(self.el("p", self.words(3, 30)) for _ in range(r.randint(1, 3)))
            out += self.el("div", box, "", self.some(["widget", *NEUTRAL_NAMES])) if r.random() < 0.5 else box
        return self.part("side", out)

    def notice(self) -> str:
        r = self.rng
        said = html.escape(r.choice(NOTICE), quote=False) if r.random() < 0.6 else self.words(4, 25)
        said = self.el("p", said) if r.random() < 0.5 else said
        return self.part("notice", said + (self.el("button", self.words(1, 2)) if r.random() < 0.6 else "") + (self.link() if r.random() < 0.3 else ""))

    def ad(self) -> str:
        r = self.rng
        said = self.words(3, 25)
        return self.part("ad", r.choice([said, self.el("p", said), f'<a href="/ad">{said}</a>', said + self.link()]))

    def form(self) -> str:
        r = self.rng
        inner = "".join(
            r.choice([self.el("label", self.words(1, 3)), '<input type="text" name="q">', self.el("button", self.words(1, 2)), self.el("textarea", self.words(1, 4)), self.el("select", "".join(self.el("option", self.words(1, 2)) for _ in range(3)))])
            for _ in range(r.randint(1, 6))
        )
        if r.random() < 0.3:
            inner = self.el("p", self.words(3, 14)) + inner
        return self.el("form", inner, "b", self.some(PART_NAMES["form"]) if r.random() < 0.5 else []) if r.random() < 0.7 else self.part("form", self.el("form", inner))

    def comment(self) -> str:
        r = self.rng
        tag = r.choice(["li", "div", "article", "div"])
        each = [self.el(tag, (self.el(r.choice(["b", "span", "cite", "h4"]), self.words(1, 2)) if r.random() < 0.7 else "") + "".join(self.el("p", self.words(2, 60)) for _ in range(r.randint(1, 2))), "", ["comment"] if r.random() < 0.6 else []) for _ in range(r.randint(1, 6))]
        inner = (self.el(r.choice(["h2", "h3"]), self.words(1, 3)) if r.random() < 0.6 else "") + (self.el("ol", "".join(each)) if tag == "li" else "".join(each))
        return self.part("comment", inner + (self.form() if r.random() < 0.3 else ""))

    def share(self) -> str:
        return self.part("share", self.links(2, 5) if self.rng.random() < 0.6 else self.words(1, 6))

    def code(self) -> str:
        return self.rng.choice(['<script>var t="</p>";run(1);</script>', "<style>p{margin:0}</style>", "<noscript data-truth=b>Please enable scripts.</noscript>", '<!-- ad --><script src="x.js"></script>'])

    def inline(self, text: str) -> str:
        """Escaped text with some words in inline elements."""
        r = self.rng
        words = text.split(" ")
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            i = r.randrange(len(words))
            tag = r.choice(["b", "em", "a", "span", "i", "strong"])
            words[i] = f"<{tag}" + (' href="/w"' if tag == "a" else "") + f">{html.escape(words[i], quote=False)}</{tag}>" if words[i] and "<" not in words[i] and "&" not in words[i] else html.escape(words[i], quote=False) if "<" not in words[i] else words[i]
        return " ".join(w if w.startswith("<") and w.endswith(">") and "</" in w else html.escape(w, quote=False) for w in words)

    def body(self, title: str, blocks: list[str]) -> str:
        """The article's inside: blocks with parts that do not belong to it in between."""
        r = self.rng
        how = r.choice(["p", "p", "p", "p", "div", "br", "mixed"])
        out = [self.el(r.choice(["h1", "h1", "h2"]), html.escape(title, quote=False))] if title and r.random() < 0.85 else []
        if out and r.random() < 0.15:
            out = [self.el("header", out[0])]
        plain = []
        for i, b in enumerate(blocks):
            if how == "br":
                plain.append(html.escape(b, quote=False))
                continue
            kind = r.choice(["p", "p", "p", "div", "blockquote", "li", "td", "h2", "figcaption", "pre"]) if how == "mixed" else how
            if kind == "li":
                out.append(self.el(r.choice(["ul", "ol"]), self.el("li", self.inline(b))))
            elif kind == "td":
                out.append(self.el("table", self.el("tr", self.el("td", self.inline(b)) + self.el("td", self.words(1, 3)))))
            elif kind == "figcaption":
                out.append(self.el("figure", '<img src="/i.png" alt="">' + self.el("figcaption", self.inline(b))))
            else:
                out.append(self.el(kind, self.inline(b), closed=not (self.unclosed and kind == "p")))
        if plain:
            out.append("<br><br>".join(plain))
        for make, chance in ((self.ad, 0.25), (self.share, 0.25), (self.side, 0.15), (self.form, 0.1), (self.comment, 0.2), (self.code, 0.15), (self.notice, 0.07), (self.nav, 0.08), (self.foot, 0.06)):
            if r.random() < chance:
                out.insert(len(out) if make == self.comment else r.randint(0, len(out)), make())
        return "".join(out)

    def page(self, title: str, blocks: list[str]) -> str:
        r = self.rng
        inside = self.body(title, blocks)
        how = r.random()
        names = self.some(CONTENT_NAMES, 2) if r.random() < 0.7 else self.some(NEUTRAL_NAMES)
        bare = how > 0.94
        if bare:
            main = inside
        elif how < 0.3:
            main = self.el("article", inside, "c", self.some(CONTENT_NAMES) if r.random() < 0.4 else [])
        elif how < 0.42:
            main = self.el("main", inside, "c", self.some(CONTENT_NAMES) if r.random() < 0.3 else [])
        elif how < 0.5:
            main = self.el("table", self.el("tr", (self.el("td", self.links(3, 8), "b") if r.random() < 0.6 else "") + self.el("td", inside, "c", names if r.random() < 0.3 else [])))
        else:
            main = self.el(r.choice(["div", "div", "div", "section"]), inside, "c", names if r.random() < 0.9 else [])
        if not bare:
            sides = [self.side() if r.random() < 0.3 else "", self.side() if r.random() < 0.35 else "", self.comment() if r.random() < 0.2 else "", self.share() if r.random() < 0.15 else "", self.ad() if r.random() < 0.2 else ""]
            main = sides[0] + main + sides[3] + sides[4] + sides[2] + sides[1]
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                main = self.el(r.choice(["div", "div", "main", "section"]), main, "", self.some(NEUTRAL_NAMES + CONTENT_NAMES[:4], 2) if r.random() < 0.7 else [])
        before = "".join(make() for make, chance in ((self.notice, 0.15), (self.head, 0.5), (self.nav, 0.55), (self.ad, 0.3), (self.form, 0.15), (self.code, 0.2)) if r.random() < chance)
        after = "".join(make() for make, chance in ((self.side, 0.1), (self.ad, 0.15), (self.form, 0.12), (self.foot, 0.75), (self.notice, 0.15), (self.code, 0.3)) if r.random() < chance)
        top = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{html.escape(title, quote=False)}</title>{self.code()}</head>' if r.random() < 0.9 else ""
        body = "<body data-truth=c>" if bare else "<body>"
        end = "</body></html>" if r.random() < 0.85 else ""
        return top + body + before + main + after + end
