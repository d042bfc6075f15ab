"""Article extraction: layouts with known articles, the driver's pages, and pages that are only tags."""

import html as entities
import re
import time

import pytest

from lorebank.llm import html_extract

DIR = "/root/testdata/sf0.001"
A = "The river rose again last night. People moved to the hills before dawn, and no one was hurt."
B = "Officials said the water should fall by Friday."
C = "Short one."
#: Pages and the blocks of their articles; none of them is made by the generator that the weights are learned from.
LAYOUTS = {
    "has-sidebar": (f'<body><div class="content has-sidebar"><h1>Flood in the north</h1><p>{A}</p><p>{B}</p></div><div class="sidebar"><ul><li><a href="/a">Sport</a></li><li><a href="/b">Weather</a></li></ul></div></body>', ["Flood in the north", A, B]),
    "share-price": (f'<main><h1>Markets</h1><p>{A}</p><p class="share-price">The price of a share rose by two per cent.</p><p>{B}</p></main>', ["Markets", A, "The price of a share rose by two per cent.", B]),
    "label in a sentence": (f"<article><h2>How to vote</h2><p>{A}</p><p>Tick the box with the <label>postal vote</label> name and send the form back.</p></article>", ["How to vote", A, "Tick the box with the postal vote name and send the form back."]),
    "link list before, teasers after": (
        '<body><ul><li><a href="/1">Home</a></li><li><a href="/2">News</a></li><li><a href="/3">About us</a></li></ul>'
        f"<div><h1>Flood in the north</h1><p>{A}</p><p>{B}</p><p>{C}</p></div>"
        '<div><div><h3><a href="/x">Mayor opens a bridge</a></h3><p>The new bridge links both banks of the river.</p></div><div><h3><a href="/y">Rain to return</a></h3><p>More rain is on the way, the office says.</p></div></div></body>',
        ["Flood in the north", A, B, C],
    ),
    "advert and share bar inside": (f'<div class="post"><h1>Flood</h1><p>{A}</p><div class="ad-slot">Buy boots now, half price!</div><p>{B}</p><div class="share-buttons"><a href="/f">Share</a> <a href="/t">Tweet</a></div><p>{C}</p></div>', ["Flood", A, B, C]),
    "comments": (f'<article><h1>Flood</h1><p>{A}</p><p>{B}</p><section id="comments"><h3>2 comments</h3><p>I saw it with my own eyes, it was a terrible night for all of us here.</p><p>So did I.</p></section></article>', ["Flood", A, B]),
    "cookie notice and forms": (f'<div id="cookie-notice"><p>We use cookies to make this site better for you. Read our policy.</p></div><header><a href="/">The Paper</a></header><main><h1>Flood</h1><p>{A}</p><form action="/s"><label>Mail</label><input><button>Sign up</button></form><p>{B}</p></main><footer>All rights reserved by The Paper.</footer>', ["Flood", A, B]),
    "headings, lists and a quote": (f"<article><header><h1>Flood in the north</h1></header><p>{A}</p><h2>What to do</h2><ul><li>Stay at home.</li><li>Keep the radio on.</li></ul><blockquote>{B}</blockquote><p>{C}</p></article><aside><h3>Most read</h3><a href='/q'>Sport</a></aside>", ["Flood in the north", A, "What to do", "Stay at home.", "Keep the radio on.", B, C]),
    "table layout": (f'<table><tr><td><a href="/1">Home</a></td><td><a href="/2">News</a></td></tr></table><table><tr><td><h1>Flood</h1><p>{A}</p><p>{B}</p></td></tr></table><div class="footer"><a href="/i">Imprint</a></div>', ["Flood", A, B]),
    "open paragraphs and references": (f"<nav><a href='/'>Home</a></nav><article><h1>R&amp;D &ndash; news</h1><p>{A}<p>{B}<br>It&#39;s so.<p>{C}</article><footer>&copy; us</footer>", ["R&D – news", A, f"{B} It's so.", C]),
    "scripts and styles": (f'<head><title>T</title><style>p{{}}</style></head><body><script>var a = "<p>no</p>";</script><div class="entry-content"><h1>Flood</h1><p>{A}</p><script>track(1)</script><noscript>Turn it on.</noscript><p>{B}</p><select><option>Choose</option></select></div></body>', ["Flood", A, B]),
    "no names, deep divs": (f'<div><div><a href="/a">One</a> | <a href="/b">Two</a> | <a href="/c">Three</a></div><div><div><h1>Flood</h1><p>{A}</p><p>{B} <a href="/m">See the map</a> of the north.</p></div></div><div><a href="/d">Terms</a> <a href="/e">Contact</a></div></div>', ["Flood", A, f"{B} See the map of the north."]),
    "with-nav on the body": (f'<body class="with-nav no-comments"><div class="main-nav"><a href="/a">One</a><a href="/b">Two</a></div><section class="story"><h1>Flood</h1><p class="menu-price">{A}</p><p>{B}</p></section></body>', ["Flood", A, B]),
    "only menus": ('<nav><a href="/a">One</a><a href="/b">Two</a></nav><footer>&copy; 2020 us</footer>', []),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    page, blocks = LAYOUTS[name]
    assert html_extract.main_text(page, html_extract.learned()) == "\n".join(blocks)


def test_plain_page():
    w = html_extract.learned()
    page = (
        "<html><head><title>t</title></head><body><div class='cookie-notice'>We use cookies here ok</div><nav><a>Home</a></nav><div class='post-body'><h1>Title &amp; more</h1>"
        "<p>First  para with <b>bold</b> words<br>and a break.</p><aside>Related stuff here</aside><p>Second one&nbsp;here it is.</p></div>"
        "<form>Sign up now for it</form><div id='comments'><p>A reader says many words about this and more</p></div><footer>(c) us</footer></body></html>"
    )
    assert html_extract.main_text(page, w) == "Title & more\nFirst para with bold words and a break.\nSecond one here it is."
    assert html_extract.main_text(None, w) == html_extract.main_text("", w) == html_extract.main_text("<nav>a b c</nav>", w) == ""


def test_pages_that_end_early():
    """What a page leaves open at its end: a script, a remark, a tag, or plain text without any tag."""
    w = html_extract.learned()
    body = f"<article><h1>Flood</h1><p>{A}</p><p>{B}"
    whole = "\n".join(["Flood", A, B])
    for end in ("", "<script>if (a > b) { go()", "<script>go()", "<!-- a > remark", "<!-- a remark", "<style>p > b {", "</p"):
        assert html_extract.main_text(body + end, w).removesuffix("</p") == whole, end
    assert html_extract.main_text(f"{A} {B}", w) == f"{A} {B}"


def test_labelled_pages_that_were_not_learned():
    """Of the words of generated pages at most one in a hundred is missed or taken too much."""
    w, mine, missed, extra = html_extract.learned(), 0, 0, 0
    for page in html_extract.labelled(150, 99):
        want = sum(x.startswith("w") for x in re.sub("<[^>]*>", " ", page).split())
        got = html_extract.main_text(page, w).split()
        mine += want
        missed += want - sum(x.startswith("w") for x in got)
        extra += sum(x.startswith("z") for x in got)
    assert missed + extra <= 0.01 * mine


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_pages_of_the_driver(spark, size):
    for r in spark.read.parquet(f"/root/testdata/{size}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (" ".join(entities.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body))
        assert html_extract.main_text(r.html, html_extract.learned()) == "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("tags", ["<nav>", "<div class=ad>", "<p>", "<a ", "<b>x ", "</p>", "<p><b>", "<li><p>", "<a '", '<a "x'])
def test_unclosed_tags_take_linear_time(tags):
    w = html_extract.learned()
    began = time.time()
    html_extract.main_text(tags * 100_000 + ">some words here", w)
    assert time.time() - began < 2


def test_very_long_page(spark):
    """One article of a million words, whole."""
    body = "".join(f"<p>{'word ' * 99}{i}.</p>" for i in range(10_000))
    page = f"<nav><a href='/'>Home</a></nav><article>{body}</article><footer>end of it</footer>"
    got = html_extract.extract(spark.createDataFrame([(1, "u", page), (1, "u", page)], "page_id long, url string, html string")).collect()
    assert [len(r.text.split()) for r in got] == [1_000_000] * 2 and got[0] == got[1]


@pytest.mark.parametrize(
    "page",
    ["<p><button>" + "<h2>" * 100_000, "".join(f"<x{i} class=a>" for i in range(100_000)) + "t", "<p>" * 100_000, "<ul>" + "<li><p>a" * 50_000, "<button><p>" * 50_000, "<table><tr><td>" * 33_000],
    ids=["headings", "unknown", "paragraphs", "items", "buttons", "cells"],
)
def test_time_grows_with_the_page(page):
    """A hundred thousand tags of any mix; a look back over the open elements for each would take minutes."""
    began = time.process_time()
    html_extract.read(page)
    assert time.process_time() - began < 10


def test_a_button_holds_a_paragraph_of_its_own():
    blocks = lambda page: {x.text: x.block for x in html_extract.read(page)[0] if not isinstance(x, str)}
    first = blocks("<p>a<div>b</div>c</p>d")
    assert len({first["a"], first["b"], first["c"]}) == 3  # the paragraph ended before the div
    assert "b" not in blocks("<p>a<button>b<p>c</button>d") and len(set(blocks("<p>a<p>b").values())) == 2
