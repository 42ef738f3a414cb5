"""HTML extraction against pages whose text is known from how they are made, and on broken pages."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vecspark.llm import html_extract

LONG = "This is the first part of the article and it has a number of words that are in the language of the page."

# A page as a tree: (html, text that belongs to the article).
WORDS = st.lists(st.sampled_from(["the", "of", "x1", "wörd", "a&amp;b", "1 &lt; 2", "\n", "end."]), min_size=1, max_size=8).map(" ".join)
PLAIN = {"a&amp;b": "a&b", "1 &lt; 2": "1 < 2"}


def shown(text):
    for k, v in PLAIN.items():
        text = text.replace(k, v)
    return " ".join(text.split())


LEAF = st.one_of(
    WORDS.map(lambda w: (f"<p>{w}</p>", [shown(w)])),
    WORDS.map(lambda w: (f"<p class='lead feedback'>{w}", [shown(w)])),
    WORDS.map(lambda w: (f"<h2 id=side>{w}</h2>", [shown(w)])),
    WORDS.map(lambda w: (f"<p><a href='/x'>{w}</a></p>", [shown(w)])),
    WORDS.map(lambda w: (f"<ul><li>{w}<li>{w}</ul>", [shown(w), shown(w)])),
    WORDS.map(lambda w: (f"<p>{w}<br>{w}<!-- {w} --></p>", [shown(f"{w} {w}")])),
    WORDS.map(lambda w: (f"<form><input name=a>{w}</form>", [])),
    WORDS.map(lambda w: (f"<div class='my-ad wide'><p>{w}</div>", [])),
    WORDS.map(lambda w: (f"<section id=comments><article class=comment><p>{w}</article></section>", [])),
    WORDS.map(lambda w: (f"<script>var t = '</p>{w}';</script><style>p > a {{}}</style>", [])),
    st.sampled_from([("<svg/>", []), ("<video src=x>", []), ("<object data=x>", []), ("<svg><title>no</title><path d='M0'/></svg>", []), ("<nav><ul><li><a href=/>Home</a></ul></nav>", []), ("<hr>", [])]),
)


def nested(children):
    joined = st.lists(children, max_size=4).map(lambda c: ("".join(x for x, _ in c), [t for _, own in c for t in own]))
    return st.one_of(
        joined.map(lambda c: (f"<div class='no-sidebar'>{c[0]}</div>", c[1])),
        joined.map(lambda c: (f"<section data-id='ad'>{c[0]}</section>", c[1])),
        joined.map(lambda c: (f"<aside>{c[0]}</aside>", [])),
        joined.map(lambda c: (f"<div hidden>{c[0]}</div>", [])),
        joined.map(lambda c: (f"<blockquote>{c[0]}</blockquote>", c[1])),
    )


@settings(max_examples=300, deadline=None)
@given(st.lists(st.recursive(LEAF, nested, max_leaves=8), max_size=5), st.sampled_from(["<article>", "<article class='post side'>", "<main id=search>", "<ARTICLE\nclass=hentry >"]))
def test_made_pages(parts, start):
    body, texts = "".join(x for x, _ in parts), [t for _, own in parts for t in own if t]
    page = f"<!DOCTYPE html><html><head><title>T &lt;</title><script>x</script></head><body><header>Site</header><nav><a href=x>{LONG}</a></nav><div class='cookie-bar'>{LONG}</div>{start}{body}</article></main><footer>&copy; {LONG}</footer></body></html>"
    assert html_extract.main_text(page) == " ".join(texts)


@pytest.mark.parametrize(("page", "text"), [
    ('<article class="post side"><p>' + LONG + "</p></article>", LONG),
    ("<article><p>One...</p><svg/><p>Two...</p></article>", "One... Two..."),
    ("<article><p>One...</p><video src=x><p>Two...</p></article>", "One... Two..."),
    ("<article><p><a href=x>only a link</a></p><p>tiny</p></article>", "only a link tiny"),
    ("<article>5 < 6 and <3 </> x</article>", "5 < 6 and <3 x"),
    ("<article><a title='a > b' href=\"x>y\">in</a> out</article>", "in out"),
    ("<article><p>in<a href='x", "in"),
    (f"<form id=aspnet><article>{LONG}</article></form>", LONG),
    (f"<div class=sidebar><article>teaser of another page</article></div><article>{LONG}</article>", LONG),
    (f"<article>{LONG}</article><div class=x><p>{LONG[:80]}</p></div>", LONG),
    (f"<div><p>{LONG}</p><p>{LONG}</p></div><div class=box><article>Teaser.</article></div>", f"{LONG} {LONG} Teaser."),
    ("<article>" + "word " * 200_000 + "</article>", ("word " * 200_000).strip()),
])
def test_pages(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize("make", [
    lambda n: "<a" + " x= y" * n, lambda n: "<a b " * n, lambda n: "<" * n, lambda n: '<div class="' * n, lambda n: "<p class='" * n, lambda n: "<title>" * n, lambda n: "</div>" * n, lambda n: "<div>" * n + "</p>" * n,
    lambda n: "<!--" * n, lambda n: "<a " + " " * n, lambda n: "<svg></p>" * n, lambda n: "<nav>x" * n, lambda n: "<p><div></p>" * n, lambda n: "<li><td>" * n, lambda n: "&amp" * n, lambda n: "<div class='" + "ad-x " * n + "'>x",
    lambda n: "<div class='" + "no-" * n + "'>x", lambda n: "<div style='" + "display " * n + "'>x", lambda n: "<textarea><iframe>" * n,
])
def test_time_is_linear(make):
    began = time.process_time()
    html_extract.main_text(make(50_000))
    assert time.process_time() - began < 10  # a quadratic scan takes minutes


def test_odd_rows(spark):
    """Null ids, repeated rows, null pages and extra columns: each row gets a row."""
    rows = [(None, "u", f"<p>{LONG}"), (1, None, None), (1, None, None), (2, "u", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    out = sorted(map(tuple, html_extract.html_extract(pages).collect()), key=str)
    assert out == sorted([(None, "u", LONG, len(LONG)), (1, None, "", 0), (1, None, "", 0), (2, "u", "", 0)], key=str)
