"""Main text of pages against the given template and written pages."""

import html
import re

import pytest

from pulseline.llm.common import table
from pulseline.llm.html_text import Classifier, extract, main_text
from pulseline.llm.queries import QUERIES

MEDIUM = "/root/testdata/sf0.01"
LONG = (
    "This is the first part of the story that was told to all of the people who were in the house, "
    "and it is as long as it has to be for them to be able to follow what is said in it on that day."
)
WORDS = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore"


@pytest.fixture(scope="module")
def text():
    rules = Classifier()
    return lambda page: extract(page, rules)


def test_given_pages(spark):
    """The given pages hold their text in one article, so a pattern finds it."""
    pages = {r.page_id: r for r in table(spark, MEDIUM, "pages").collect()}
    got = QUERIES["op13_html_text"](spark, MEDIUM).collect()
    assert len(got) == len(pages)
    squeeze = lambda t: " ".join(t.split())
    docs = {squeeze(r.text or "") for r in table(spark, MEDIUM, "documents").collect()}
    for r in got:
        inside = re.search("<article>(.*)</article>", pages[r.page_id].html, re.DOTALL)[1]
        parts = re.split("</?(?:p|h1)>", inside)
        lines = [squeeze(html.unescape(re.sub("<[^>]*>", " ", p))) for p in parts]
        assert r.text.split("\n") == [x for x in lines if x]
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url
        # Behind the title it is the whole text of a document.
        assert squeeze(r.text.split("\n", 1)[1]) in docs


def test_boilerplate_goes(text):
    page = f"""<!doctype html><html><head><title>T</title><style>p {{}}</style></head><body class="has-sidebar">
    <div id="siteHeader">The Site</div><ul class="menu"><li><a href=/>Home</a><li><a href=/x>About us</a></ul>
    <div class="cookie-notice"><p>{LONG}</p></div>
    <div id="content"><h1>The title</h1><p>{LONG}<p>Short.
    <div class="advert">{LONG}</div><ul><li>one</li><li>two</li></ul>
    <form action="/s"><p>{LONG}</p><input><button>Send</button></form></div>
    <div class="sidebar widget"><p>{LONG}</p></div>
    <section id="comments"><article><p>{LONG}</p></article></section>
    <script>document.write("<p>{LONG}</p>")</script><noscript><p>{LONG}</p></noscript>
    <footer>&copy; The Site</footer></body></html>"""
    assert text(page) == f"The title\n{LONG}\nShort.\none\ntwo"


def test_stop_words_and_links_decide_without_marks(text):
    linked = " ".join(f"<a href=/{w}>{w}</a>" for w in LONG.split())
    page = f"<div><p>{linked}</p></div><div><p>{WORDS} {WORDS}</p></div><div><p>{LONG}</p><p>End.</p></div>"
    assert text(page) == f"{LONG}\nEnd."
    # In an article long blocks need no stop words, and a few links are no menu.
    page = f"<main><p>{WORDS}</p><p>See <a href=x>this</a> and what else there is to see.</p></main><p>{linked}</p>"
    assert text(page) == f"{WORDS}\nSee this and what else there is to see."


def test_short_blocks_follow_their_neighbours(text):
    page = f"<div><p>Teaser</p><p>{WORDS}</p></div><div><h2>Head</h2><p>{LONG}</p><p>b</p></div><div>Imprint</div>"
    page += f"<div><p>{WORDS}</p></div>"
    assert text(page) == f"Head\n{LONG}\nb"


def test_other_languages(text):
    german = "Das ist der Text, den die Leute auf dem Platz am Abend von dem Mann mit dem Hut und der Frau hören. " * 2
    menu = "Startseite Produkte Dienstleistungen Unternehmen Karriere Impressum Datenschutz Kontakt Anfahrt Presse"
    assert text(f"<div>{menu}</div><div>{german}</div>") == german.strip()
    # Without known stop words length and links decide.
    greek = "Αυτό είναι ένα μεγάλο κείμενο για τους ανθρώπους που ζουν στην πόλη κοντά στη θάλασσα. " * 2
    assert text(f"<div><a href=/>Αρχική</a></div><div>{greek}</div>") == greek.strip()


def test_markup_and_references(text):
    assert text("<p>a&nbsp;&lt;b&gt; &amp;amp; caf&eacute; &#8364;\n\t c<br>d<!-- no --></p><p> e </p>") == (
        "a <b> &amp; café € c d\ne"
    )
    assert text("<p title='a > b' data-x=\"</p>\">x</p><p class=it's>y</p><p>1 < 2</p>") == "x\ny\n1 < 2"
    assert text("<table><tr><td>a<td>b<tr><td>c</table>") == "a\nb\nc"
    assert text("one<br><br>two") == "one\ntwo"
    assert text("<svg><text>no</text></svg><p>x<![CDATA[ y & z ]]></p>") == "x y & z"


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        (" \n", ""),
        ("<nav><a href=x>y</a></nav>", ""),
        ("only words", "only words"),
        ("<p>Short page.</p><footer>f</footer>", "Short page."),
        ("<article><h1>Word</h1><p>Word</p></article><footer>f</footer>", "Word\nWord"),
        ("<script>never closed <p>x</p>", ""),
        ("<p>x <a href='never closed", "x"),
        ("<p>x</b></div></p>y", "x\ny"),
    ],
)
def test_odd_pages(text, page, want):
    assert text(page) == want


def test_very_long_pages(text):
    many = f"<p>{LONG}</p>" * 5000
    assert text(many) == "\n".join([LONG] * 5000)
    assert text("<div>" * 50_000 + "x") == "x"
    assert text("<p>x" * 20_000) == "\n".join("x" * 20_000)
    for junk in ("<", "<a href='", "<!--", "<a b=", "&#"):
        assert len(text(junk * 50_000)) <= len(junk) * 50_000


def test_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars string, label string"
    rows = [
        (1, "u", "<p>x</p>", "a", "b", "c"),
        (1, "u", "<p>x</p>", "a", "b", "c"),
        (None, None, None, None, None, None),
        (2, None, "", "a", "b", "c"),
        (3, "v", "<p>é🙂</p>", "a", "b", "c"),
    ]
    df = spark.createDataFrame(rows, schema)
    got = main_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r) for r in got.collect()), key=key) == [
        (1, "u", "x", 1),
        (1, "u", "x", 1),
        (2, None, "", 0),
        (3, "v", "é🙂", 2),
        (None, None, "", 0),
    ]
    assert main_text(df.limit(0)).count() == 0
