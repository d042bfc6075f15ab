"""Main text of a page as the maximum-scoring subsequence of its words and tags.

A page is read once, with a stack of the elements that are open. It becomes a sequence of pieces of text and tags. Words
score by the evidence of their block: its tag, its length, the share of its words in links, whether it ends like a
sentence or follows a linked heading, and the tags and the class, id and role names of the elements around it. Tags
score negative. All weights come from labelled pages, generated here in many layouts: those of words by logistic
regression, those of tags as the log of how much likelier a tag is inside the article than outside. No name or tag decides
alone: a list of names only makes features, whose weights are learned like all others.

One linear scan finds the contiguous region with the largest sum. Its text, without pieces inside it whose evidence is
clearly against them (an advert in the middle), is the article.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements whose content is no running text, elements that break lines, elements without content,
# elements whose start ends an open paragraph, and the item elements that end their like.
RAW = frozenset("script style noscript template iframe svg math object canvas audio video select textarea button datalist head title".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS_P = BLOCKS - {"body", "html", "caption", "legend", "td", "th", "tr", "tbody", "thead", "tfoot", "summary"}
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
SCOPES = frozenset("html body table td th ul ol dl article section div main aside nav button".split())

#: Tags that make a feature of all text inside them.
AROUND = ("article", "main", "nav", "header", "footer", "aside", "form", "fieldset", "menu", "dialog", "figure", "blockquote", "table", "ul", "ol", "details")
#: Names in class, id and role that make a feature, by what they are usually given to.
NAMES = {
    "ad": "ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner",
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs pagination pager toc skip tabs",
    "head": "header masthead topbar logo branding",
    "foot": "footer foot colophon copyright contentinfo",
    "side": "sidebar side aside related recommended widget teaser teasers more complementary trending",
    "share": "share sharing social newsletter subscribe signup login search follow",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay",
    "talk": "comment comments respond reply replies disqus discussion",
    "text": "content article post entry story body main text",
}
GROUP = {name: group for group, names in NAMES.items() for name in names.split()}
#: First parts that turn a name into a remark on the layout.
REMARKS = frozenset("has with no without is not".split())
#: Elements that hold running text themselves.
LINES = frozenset("p h1 h2 h3 h4 h5 h6 li td th dd dt span b i em strong a small blockquote pre figcaption caption label".split())
KIND = {**{f"h{k}": "heading" for k in range(2, 7)}, "h1": "h1", "p": "p", "li": "li", "td": "cell", "th": "cell", "dd": "li", "dt": "li", "blockquote": "quote", "pre": "quote", "figcaption": "caption"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*+>.*?(?:</\1\s*+>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|<[!?/][^>]*+>|([^<]++|<)",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""", re.I)
PART = re.compile(r"[a-z0-9]+|[A-Z][a-z0-9]*")
#: Elements whose last end tag is sought by itself; others could be as many as a page has tags.
KNOWN = BLOCKS | RAW | LINES | SCOPES | {*AROUND, "a"}
END_TAG = re.compile(r"</([a-z][a-z0-9:-]*)")
CLOSED = re.compile(r"</(?:script|style)\s*>\Z", re.I)


class Piece(NamedTuple):
    """Text in one block under one set of features; ``linked`` if it is in a link."""

    block: int
    mask: int
    text: str
    linked: bool


_BITS: dict[str, int] = {}


def bit(feature: str) -> int:
    return 1 << _BITS.setdefault(feature, len(_BITS))


for _name in AROUND:
    bit(f"in {_name}")
for _kind in ("header", "footer"):
    bit(f"{_kind} of article")
for _group in NAMES:
    for _form in ("is", "part", "remark"):
        for _level in ("around", "line"):
            bit(f"{_group} {_form} {_level}")


@lru_cache(maxsize=65536)
def marks(tag: str, attributes: str) -> int:
    """Features of an element's names: a name is one of NAMES, starts or ends with one, or is a remark on it."""
    out, level = 0, "line" if tag in LINES else "around"
    for _, *values in NAMED.findall(attributes):
        for name in " ".join(values).split():
            parts = [p.lower() for p in PART.findall(name)]
            if len(parts) == 1 and parts[0] in GROUP:
                out |= bit(f"{GROUP[parts[0]]} is {level}")
            elif parts and parts[0] in REMARKS:
                out |= sum({bit(f"{GROUP[p]} remark {level}") for p in parts if p in GROUP})
            else:
                out |= sum({bit(f"{GROUP[p]} part {level}") for p in (parts[:1] + parts[-1:]) if p in GROUP})
    return out


def read(page: str) -> tuple[list[Piece | str], dict[int, str]]:
    """The pieces of text and the tags of a page in order, and the tag of each block.

    An end tag closes its element and those left open inside it; one without an element is dropped. A start tag ends an
    open paragraph, or item of its list, as in HTML. An element that is never closed is no reason for a feature.
    """
    out: list[Piece | str] = []
    kinds: dict[int, str] = {0: "body"}
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, features, raw, link
    open_, block = Counter(), 0
    low = page.lower()
    last_end: dict[str, int] = {}
    last_close = page.rfind(">")

    paragraphs: list[int] = []  # places in the stack of open paragraphs, and of what a tag inside does not end one across
    scopes: list[int] = []
    ends: dict[str, int] = {}

    def pop(name: str) -> None:
        while True:
            tag = stack.pop()[0]
            open_[tag] -= 1
            if tag == "p":
                paragraphs.pop()
            elif tag in SCOPES:
                scopes.pop()
            if tag == name:
                return

    def last(name: str) -> int:
        """Where the last end tag of an element starts; those of all unknown elements are found together."""
        if name in KNOWN:
            return low.rfind(f"</{name}")
        if not ends:
            ends[""] = -1
            ends.update((x.group(1), x.start()) for x in END_TAG.finditer(low))
        return ends.get(name, -1)

    rest = page[last_close + 1 :]
    for m in TOKEN.finditer(page, 0, last_close + 1):
        script, closing, name, attributes, text = m.groups()
        tag, mask, raw, link = stack[-1]
        if m.end() == last_close + 1 and (script and not CLOSED.search(m.group()) or m.group().startswith("<!--") and not m.group().endswith("-->")):
            rest = ""  # a script or remark without an end reaches to the end of the page
        if text is not None:
            if not raw:
                out.append(Piece(block, mask, text, link))
            continue
        if name is None:
            continue
        name = name.lower()
        if closing:
            if open_[name]:
                pop(name)
        else:
            if name in ENDS_P and paragraphs and (not scopes or scopes[-1] < paragraphs[-1]):
                pop("p")
            like = ITEMS.get(name, ())
            while like and stack[-1][0] not in SCOPES - {"td", "th"} and any(open_[x] for x in like):
                top = stack[-1][0]
                pop(top)
                if top in like and not (name == "tr" and top != "tr"):
                    break
            if name not in VOID and not attributes.rstrip().endswith("/"):
                if name not in last_end:
                    last_end[name] = last(name)
                closed = last_end[name] > m.start()
                _, mask, raw, link = stack[-1]
                if closed and not raw:
                    mask |= marks(name, attributes)
                    if name in AROUND:
                        inner = name in ("header", "footer") and mask & (bit("in article") | bit("in main"))
                        mask |= bit(f"{name} of article") if inner else bit(f"in {name}")
                open_[name] += 1
                if name == "p":
                    paragraphs.append(len(stack))
                elif name in SCOPES:
                    scopes.append(len(stack))
                stack.append((name, mask, raw or (closed and name in RAW), link or (closed and name == "a" and "href" in attributes.lower())))
        if raw or stack[-1][2]:
            continue
        if name in BLOCKS:
            block += 1
            kinds[block] = next((x[0] for x in reversed(stack[-4:]) if x[0] in BLOCKS), "div")
        elif name == "br":
            out.append(Piece(block, stack[-1][1], " ", False))
        out.append(f"{'/' if closing else ''}{name}")
    rest = rest.partition("<!--")[0]
    if rest and not stack[-1][2]:
        out.append(Piece(block, stack[-1][1], rest, stack[-1][3]))
    return out, kinds


ENDING = re.compile(r"[.!?…:;।。！？][\"'”’»)\]*_]*$")


def block_features(out: list[Piece | str], kinds: dict[int, str]) -> dict[int, tuple[str, ...]]:
    """Features of each block with words."""
    words, linked, tail = Counter(), Counter(), {}
    for x in out:
        if isinstance(x, Piece):
            k = len(x.text.split())
            if k:
                words[x.block] += k
                linked[x.block] += k * x.linked
                tail[x.block] = x.text
    found, before = {}, ""
    for b in sorted(words):
        kind, n = KIND.get(kinds[b], "other"), words[b]
        share = linked[b] / n
        links = "none" if not share else "some" if share <= 0.34 else "much" if share <= 0.8 else "all"
        size = "1" if n <= 2 else "3" if n <= 5 else "6" if n <= 12 else "13" if n <= 30 else "31"
        end = "sentence" if ENDING.search(entities.unescape(tail[b]).rstrip()) else "open"
        found[b] = (f"kind {kind}", f"links {links}", f"size {size}", f"end {end}", f"{kind} {size}", f"{kind} {links}", f"{size} {end}", *(("after linked heading",) if before == "linked heading" else ()))
        before = "linked heading" if kind in ("heading", "h1") and links == "all" else "text"
    return found


def _names(mask: int) -> list[str]:
    return [f for f, i in _BITS.items() if mask >> i & 1]


class Weights(NamedTuple):
    """Log odds of features to be in the article, with a bias, and the scores of tags."""

    feature: dict[str, float]
    bias: float
    tag: dict[str, float]


#: Bounds of a word's score; evidence from which a piece inside the region is left out, and what its words then cost; the score of a tag that no labelled page has.
MOST, AGAINST, GAP, UNSEEN = 1.0, -1.5, 0.1, -0.2


def scored(out: list[Piece | str], kinds: dict[int, str], weights: Weights) -> list[float]:
    """The log odds of each piece; for a tag its score."""
    blocks = {b: weights.bias + sum(weights.feature.get(f, 0.0) for f in fs) for b, fs in block_features(out, kinds).items()}
    around: dict[int, float] = {}
    result = []
    for x in out:
        if isinstance(x, str):
            result.append(weights.tag.get(x, UNSEEN))
            continue
        if x.mask not in around:
            around[x.mask] = sum(weights.feature.get(f, 0.0) for f in _names(x.mask))
        result.append(blocks.get(x.block, 0.0) + around[x.mask])
    return result


def region(out: list[Piece | str], odds: list[float]) -> tuple[int, int]:
    """First and past-the-last place of the contiguous region with the largest sum, of equal ones the first; (0, 0) if none is above 0."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, (x, s) in enumerate(zip(out, odds, strict=True)):
        if total <= 0:
            total, start = 0.0, i
        if isinstance(x, str):
            total += s
        elif s > AGAINST:
            total += max(-MOST, min(MOST, s)) * len(x.text.split())
        else:  # left out in any case, so it parts the region only if much of it comes together
            total -= min(1.0, GAP * len(x.text.split()))
        if total > best:
            best, span = total, (start, i + 1)
    return span


def main_text(page: str | None, weights: Weights) -> str:
    """Blocks of the article joined by line feeds, with character references decoded and white space as single blanks."""
    out, kinds = read(page or "")
    odds = scored(out, kinds, weights)
    first, last = region(out, odds)
    blocks: dict[int, list[str]] = {}
    for x, s in zip(out[first:last], odds[first:last], strict=True):
        if not isinstance(x, str) and s > AGAINST:
            blocks.setdefault(x.block, []).append(entities.unescape(x.text))
    return "\n".join(t for t in (" ".join("".join(b).split()) for b in blocks.values()) if t)


# Labelled pages: words that start with w are the article's.


def labelled(n: int, seed: int) -> Iterator[str]:
    """Pages in many layouts, marked up with and without telling names."""
    r = random.Random(seed)
    pick = r.choice

    def words(lo: int, hi: int, mine: bool, stop: str = ".") -> str:
        return " ".join(("w" if mine else "z") + pick("aeiou") for _ in range(r.randint(lo, hi))) + stop

    def named(*names: str) -> str:
        return f' {pick(("class", "class", "id"))}="{pick(names)}"' if r.random() < 0.85 else ""

    def within(body: str) -> str:
        return pick(("{}", "<p>{}</p>", "<div>{}</div>", "<p>{}</p>", "<span>{}</span>")).format(body)

    def link(lo: int = 1, hi: int = 3, mine: bool = False) -> str:
        return f'<a href="/">{words(lo, hi, mine, "")}</a>'

    def links(k: int) -> str:
        kind = r.random()
        if kind < 0.5:
            return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(k)) + "</ul>"
        if kind < 0.7:
            return "<table><tr>" + "".join(f"<td>{link()}</td>" for _ in range(k)) + "</tr></table>"
        if kind < 0.85:
            return "".join(f"<div>{link()}</div>" for _ in range(k))
        return pick((" ", " | ", "")).join(link() for _ in range(k))

    def inline(mine: bool) -> str:
        tag = pick(("b", "i", "em", "a", "span", "code", "label", "strong", "a"))
        return f"{words(1, 6, mine, '')} <{tag}{pick(('', ' href=#', named('note', 'term')))}>{words(1, 3, mine, '')}</{tag}>{pick((' ', ', '))}{words(1, 25, mine)}"

    def paragraph() -> str:
        body = pick((words(1, 3, True), words(4, 15, True), words(10, 40, True), words(20, 90, True), inline(True), inline(True), f"{words(3, 20, True)}<br>{words(2, 20, True)}"))
        names = named("lead", "intro", "share-price", "ad-hoc", "first", "post-text", "side-note", "no-comments", "story-text", "menu-price") if r.random() < 0.15 else ""
        return pick((f"<p{names}>{body}</p>", f"<p{names}>{body}</p>", f"<p{names}>{body}"))

    def part() -> str:
        kind = r.random()
        if kind < 0.72:
            return paragraph()
        if kind < 0.8:
            return heading()
        if kind < 0.87:
            tag = pick(("ul", "ol"))
            return f"<{tag}>" + "".join(f"<li>{words(2, 18, True, pick(('.', '')))}</li>" for _ in range(r.randint(2, 5))) + f"</{tag}>"
        if kind < 0.91:
            return f"<blockquote>{pick((words(5, 30, True), f'<p>{words(5, 30, True)}</p>'))}</blockquote>"
        if kind < 0.94:
            return "<table>" + "".join(f"<tr><td>{words(1, 4, True, '')}</td><td>{words(1, 6, True, '')}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>"
        if kind < 0.97:
            return f"<pre>{words(5, 20, True, '')}</pre>"
        return f"<figure><img src=x><figcaption>{words(3, 15, True)}</figcaption></figure>"

    def heading() -> str:
        k = r.randint(2, 4)
        return f"<h{k}>{words(1, 8, True, '')}</h{k}>"

    def advert() -> str:
        body = within(pick((words(3, 14, False), link(2, 6), words(4, 16, False))))
        return f'<div {pick(("class", "id"))}="{pick(("ad", "ads", "advert", "ad-slot", "sponsored", "promo-box", "top-banner", "advertisement"))}">{body}</div>'

    def insert() -> str:
        kind = r.random()
        if kind < 0.45:
            return advert()
        if kind < 0.65:
            return f"<aside{named('related', 'pull', 'more')}>{pick((within(words(4, 20, False)), links(3)))}</aside>"
        if kind < 0.8:
            return f'<div class="{pick(("share", "social-links", "share-buttons", "newsletter", "related-posts"))}">{pick((links(3), within(words(2, 12, False))))}</div>'
        if kind < 0.9:
            return f'<form action="/">{within(words(2, 8, False))}<label>{words(1, 2, False, "")}</label><input><button>{words(1, 2, False, "")}</button></form>'
        return f"<nav>{links(3)}</nav>"

    def teaser() -> str:
        k = r.randint(2, 4)
        return f'<div{named("teaser", "item", "card", "box") if r.random() < 0.5 else ""}><h{k}>{link(2, 7)}</h{k}><p>{words(4, 22, False)}{pick(("", " " + link(1, 2)))}</p></div>'

    def article() -> str:
        if r.random() < 0.06:  # bare text
            return pick(("{}", "<div>{}</div>")).format(pick(("<br>", "<br><br>", " ")).join(words(8, 60, True) for _ in range(r.randint(1, 6))))
        body = [f"<h1>{words(2, 10, True, '')}</h1>" if r.random() < 0.75 else f"<h2>{words(2, 10, True, '')}</h2>"]
        if r.random() < 0.2:
            body[0] = f"<header>{body[0]}</header>"
        for _ in range(r.randint(1, 12)):
            body.append(part())
            if r.random() < 0.07:
                body.append(insert())
        if r.random() < 0.12:
            body.append(f"<footer>{pick((words(2, 12, False), links(3)))}</footer>")
        if r.random() < 0.12:
            body.append(talk())
        inside = "".join(body)
        kind = r.random()
        if kind < 0.4:
            return f"<article>{inside}</article>"
        if kind < 0.55:
            return f"<main>{inside}</main>"
        if kind < 0.85:
            tag = pick(("div", "section", "div"))
            return f'<{tag}{named("content", "post", "entry-content", "story", "article-body", "content has-sidebar", "post-body", "main", "text with-nav", "c1")}>{inside}</{tag}>'
        return pick((f"<div>{inside}</div>", f"<table><tr><td>{inside}</td></tr></table>"))

    def talk() -> str:
        each = "".join(f"<{t}>{words(2, 40, False)}</{t}>" for t in (pick(("p", "div", "li")) for _ in range(r.randint(1, 5))))
        tag = pick(("section", "div", "ol", "div"))
        return f'<{tag} {pick(("class", "id"))}="{pick(("comments", "comment-list", "disqus", "post-comments", "replies", "discussion"))}">{each}</{tag}>'

    def before() -> list[str]:
        out = []
        if r.random() < 0.3:
            tag = pick(("div", "div", "p", "section"))
            out.append(f'<{tag} {pick(("class", "id"))}="{pick(("cookie-notice", "consent", "gdpr-banner", "alert", "cookies", "notice"))}">{within(words(5, 30, False)) if tag != "p" else words(5, 30, False)}</{tag}>')
        if r.random() < 0.7:
            tag = pick(("header", "header", "div"))
            out.append(f"<{tag}{named('header', 'masthead', 'topbar', 'site-header')}>{pick((link(1, 4), words(1, 6, False, ''), f'<h1>{link(1, 3)}</h1>', f'<p>{words(3, 9, False)}</p>'))}</{tag}>")
        if r.random() < 0.8:
            tag = pick(("nav", "nav", "div"))
            out.append(f"<{tag}{named('menu', 'nav', 'navbar', 'main-nav', 'top')}>{links(r.randint(3, 9))}</{tag}>")
        if r.random() < 0.3:
            out.append(links(r.randint(2, 8)))
        if r.random() < 0.4:
            out.append(advert())
        if r.random() < 0.2:
            out.append(f"<div{named('breadcrumb', 'breadcrumbs', 'path')}>{links(3)}</div>")
        return out

    def after() -> list[str]:
        out = []
        if r.random() < 0.35:
            out.append(talk())
        if r.random() < 0.35:
            side = "".join(teaser() for _ in range(r.randint(2, 6)))
            out.append(pick((f"<div>{side}</div>", f'<div class="related">{side}</div>', side, f"<section><h2>{words(1, 3, False, '')}</h2>{side}</section>")))
        if r.random() < 0.4:
            tag = pick(("aside", "div"))
            out.append(f"<{tag}{named('sidebar', 'side', 'right-sidebar', 'widget')}>{pick((links(5), within(words(3, 30, False)), f'<h3>{words(1, 3, False, chr(32))}</h3>' + links(4)))}</{tag}>")
        if r.random() < 0.25:
            out.append(advert())
        if r.random() < 0.25:
            out.append(insert())
        if r.random() < 0.25:
            out.append(links(r.randint(2, 8)))
        r.shuffle(out)
        if r.random() < 0.8:
            tag = pick(("footer", "footer", "div"))
            name = named("footer", "foot", "site-footer") if tag == "footer" else ' class="footer"'
            out.append(f"<{tag}{name}>{pick((within(words(2, 25, False)), f'&copy; {words(1, 5, False)} {links(3)}', links(4)))}</{tag}>")
        return out

    for _ in range(n):
        middle = [article()]
        if r.random() < 0.25:
            middle.insert(0, f"<aside{named('sidebar', 'left')}>{pick((links(4), within(words(3, 20, False))))}</aside>")
        wrap = pick(("{}", "{}", '<div class="wrap">{}</div>', '<div class="page has-sidebar">{}</div>', '<div class="layout with-sidebar">{}</div>', '<div id="content">{}</div>', '<body class="no-nav">{}</body>'))
        yield f"<html><head><title>{words(2, 6, False, '')}</title></head><body>" + wrap.format("".join([*before(), *middle, *after()])) + "</body></html>"


@lru_cache(maxsize=1)
def learned(n: int = 900, seed: int = 1) -> Weights:
    """Weights from ``n`` labelled pages: logistic regression over the pieces, and rates of tags inside and outside the articles."""
    names: dict[str, int] = {}
    cols, row_of, y, weight, rows = [], [], [], [], 0
    inside, outside = Counter(), Counter()
    for page in labelled(n, seed):
        out, kinds = read(page)
        of = block_features(out, kinds)
        mine = [i for i, x in enumerate(out) if isinstance(x, Piece) and x.text.strip().startswith("w")]
        for i, x in enumerate(out):
            if isinstance(x, str):
                (inside if mine[0] - 1 <= i <= mine[-1] + 1 else outside)[x] += 1
            elif x.text.strip() and x.block in of:
                for f in (*of[x.block], *_names(x.mask)):
                    cols.append(names.setdefault(f, len(names)))
                    row_of.append(rows)
                k = len(x.text.split())
                y.append(float(x.text.strip().startswith("w")))
                weight.append(min(k, 20) ** 0.5)
                rows += 1
    x = np.zeros((rows, len(names) + 1))
    x[row_of, cols] = 1
    x[:, -1] = 1
    truth, each = np.array(y), np.array(weight)
    w = np.zeros(len(names) + 1)
    for _ in range(12):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (each * (p - truth)) + 0.5 * w
        h = (x * (each * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    n_in, n_out = sum(inside.values()), sum(outside.values())
    rate = lambda t: math.log((inside[t] + 0.5) / (n_in + 1)) - math.log((outside[t] + 0.5) / (n_out + 1))
    tags = {t: min(-0.02, max(-1.0, 0.1 * rate(t))) for t in {*inside, *outside}}
    return Weights({f: float(w[i]) for f, i in names.items()}, float(w[-1]), tags)


def _rows(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shipped.value
        for batch in batches:
            text = [main_text(x.as_py(), weights) for x in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html).

    A null or empty page, or one without words that look like an article's, has an empty text. Of regions with the same
    score the first is taken. Nothing is cut off: very long pages are read whole, in time that grows with their length.
    Rows are kept as they are, repeated or not, with or without an id; an empty table gives none; other columns are not
    read. ``weights`` are by default those of learned(), and are sent to the executors.
    """
    shipped = pages.sparkSession.sparkContext.broadcast(weights or learned())
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_rows(shipped), "page_id long, url string, text string, n_chars long")
