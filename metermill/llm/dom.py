"""Element trees of web pages: what the extraction of main texts reads of HTML.

Markup is read as browsers do where it matters for text: raw text elements, comments, unquoted and unclosed attributes, end tags that are
left out (p, li, dd, option, table parts), end tags without a start, elements still open at the end.  Time is linear in the page but for
hostile nestings.  Inline elements belong to the block element around them; only those named like boilerplate are nodes of their own.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

# fixed values: element names of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr basefont bgsound frame keygen".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
HEAD = frozenset("head base basefont bgsound link meta title".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WALLS = frozenset("table td th caption button template object html".split())
#: A start tag of the key ends an open element of the first set unless one of the second stands in between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}

#: Words of class, id, role and the like, by what they say of an element; a word ending in * stands for all that begin so.
FAMILIES = {
    "content": "article articlebody content contents post entry story main body text prose blog copy hentry maintext fulltext posting",
    "nav": "nav navbar navi navigation* menu* breadcrumb* crumb* toc pagination pager paging tabs tab sitemap skip jump",
    "head": "header* masthead topbar top branding logo hero",
    "foot": "footer* foot bottom copyright legal colophon imprint disclaimer credits",
    "side": "sidebar* side aside rail widget* related* recommend* trending popular teaser* complementary secondary promobox readmore more latest",
    "notice": "cookie* consent* gdpr notice* alert* popup modal overlay banner* paywall newsletter subscribe* subscription signup privacy dialog toast announcement",
    "ad": "ad ads adv advert* adbox adslot adunit adsense sponsor* promo promoted promotion dfp commercial affiliate outbrain taboola",
    "comment": "comment* reply replies discussion* disqus respond responses reactions thread guestbook",
    "share": "share* sharing social follow facebook twitter byline author meta tags tag rating",
    "form": "form* search* login input contact poll survey",
}
NAMES = list(FAMILIES)
BITS = {name: 1 << i for i, name in enumerate(NAMES)}
_WORD = {w: BITS[f] for f, words in FAMILIES.items() for w in words.split() if not w.endswith("*")}
_START = [(w[:-1], BITS[f]) for f, words in FAMILIES.items() for w in words.split() if w.endswith("*")]
TAG_BITS = {
    "article": "content", "main": "content", "nav": "nav", "menu": "nav", "header": "head", "footer": "foot", "aside": "side", "dialog": "notice",
    "form": "form", "search": "form", "select": "form", "button": "form", "input": "form", "textarea": "form", "option": "form", "label": "form", "fieldset": "form",
}
CODE = frozenset("script style noscript template head title iframe svg object canvas noembed noframes audio video math".split())

_TAG = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|!\[CDATA\[.*?(?:\]\]>|\Z)|(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[\s/]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?|[^\s/>=]++)*+)(?:>|\Z)|[!?/][^>]*(?:>|\Z))""",
    re.S,
)
_ATTR = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>"'][^\s>]*)))?""")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_TOKEN = re.compile(r"[A-Za-z]+")
NAMING = frozenset("class id role itemprop aria-label data-role data-component name".split())
HIDDEN = 1 << len(NAMES)
_NONE = re.compile(r"display\s*:\s*none", re.I)


@lru_cache(maxsize=4096)
def meaning(attrs: str) -> tuple[int, str]:
    """Families that an element's attributes name (and HIDDEN), and the value of data-truth."""
    bits, truth = 0, ""
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in NAMING:
            for word in _TOKEN.findall(_CAMEL.sub(" ", value)):
                word = word.lower()
                bits |= _WORD.get(word, 0) or next((b for start, b in _START if word.startswith(start)), 0)
        elif name == "hidden" or name == "style" and _NONE.search(value):
            bits |= HIDDEN
        elif name == "data-truth":
            truth = value
    return bits, truth


class Tree:
    """Nodes of a page in order: tag, parent, bits, truth, end (the node behind the subtree), and pieces of text (node, text, whether a block
    or line begins before it, whether it stands in a link)."""

    __slots__ = ("tag", "parent", "bits", "truth", "end", "pieces", "tags")

    def __init__(self) -> None:
        self.tag, self.parent, self.bits, self.truth, self.end = ["#page"], [-1], [0], [""], [0]
        self.pieces: list[tuple[int, str, bool, bool]] = []
        self.tags = [0]


def parse(page: str) -> Tree:
    t = Tree()
    stack, nodes = ["#page"], [0]  # open elements and the node each belongs to
    opened: dict[str, int] = {}
    broken = False
    at, size = 0, len(page)

    def pop_to(depth: int) -> None:
        nonlocal broken
        while len(stack) > depth:
            name, node = stack.pop(), nodes.pop()
            opened[name] -= 1
            if node != nodes[-1]:
                t.end[node] = len(t.tag)
            broken = broken or name not in INLINE

    def close(names, walls) -> None:
        if any(opened.get(n) for n in names):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i] in names:
                    pop_to(i)
                    return
                if stack[i] in walls:
                    return

    def text(raw: str) -> None:
        nonlocal broken
        if raw:
            if opened.get("head") and not raw.isspace() and stack[-1] == "head":
                pop_to(stack.index("head"))
            t.pieces.append((nodes[-1], html.unescape(raw) if "&" in raw else raw, broken, opened.get("a", 0) > 0))
            broken = False

    def start(name: str, attrs: str) -> None:
        nonlocal broken
        bits, truth = meaning(attrs) if attrs and not attrs.isspace() else (0, "")
        node = nodes[-1]
        if name not in INLINE or bits & ~BITS["content"] or truth:
            node = len(t.tag)
            t.tag.append(name)
            t.parent.append(nodes[-1])
            t.bits.append(bits | (BITS[TAG_BITS[name]] if name in TAG_BITS else 0))
            t.truth.append(truth)
            t.end.append(node + 1)
            t.tags.append(0)
        t.tags[node] += 1
        broken = broken or name not in INLINE or name == "br"
        if name not in VOID:
            stack.append(name)
            nodes.append(node)
            opened[name] = opened.get(name, 0) + 1

    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            if name == "p" or name in VOID:
                if name == "br":
                    broken = True
                elif name == "p":
                    close({"p"}, WALLS)
                    broken = True
            elif name == "body" or name == "html":
                continue
            elif opened.get(name):
                if name in INLINE:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i] == name:
                            pop_to(i)
                            break
                        if stack[i] not in INLINE:
                            break
                else:
                    close({name}, WALLS - {name} if name not in ("table", "tbody", "thead", "tfoot", "tr") else {"table"} - {name})
            continue
        if name == "html" or name == "body" and opened.get("body"):
            continue
        if name not in HEAD and name not in RAW and opened.get("head") and name not in ("noscript", "template"):
            close({"head"}, ())
        if name in ENDS_P:
            close({"p"}, WALLS)
        if name in HEADINGS and stack[-1] in HEADINGS:
            pop_to(len(stack) - 1)
        if name == "a":
            close({"a"}, WALLS)
        elif name in ENDS:
            close(*ENDS[name])
        start(name, m["attrs"])
        if name in RAW:
            stop = _closing(name).search(page, at)
            inside = page[at : stop.start() if stop else size]
            at = stop.end() if stop else size
            if name in ("title", "textarea"):
                text(inside)
            pop_to(len(stack) - 1)
    pop_to(1)
    t.end[0] = len(t.tag)
    return t


@lru_cache(maxsize=16)
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{name}[^>]*(?:>|\Z)", re.I)
