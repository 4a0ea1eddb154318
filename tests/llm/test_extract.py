"""Minimum cuts against all labellings, and pages with known content."""

import itertools
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import extract


def test_cuts_are_minimal():
    rnd = random.Random(1)
    for _ in range(300):
        n = rnd.randint(1, 8)
        unary = [rnd.randint(-5, 5) for _ in range(n)]
        edges = [(rnd.randrange(n), rnd.randrange(n), rnd.randint(0, 4)) for _ in range(rnd.randint(0, 14))]

        def cost(label):
            return sum(abs(v) for v, k in zip(unary, label) if (v > 0) != k and v) + sum(w for a, b, w in edges if label[a] != label[b])

        assert cost(extract.minimum_cut(unary, edges)) == min(cost(x) for x in itertools.product((False, True), repeat=n))


ARTICLE = ["A headline of the page", "The first paragraph goes on for a while, with <b>bold</b> words &amp; signs, so that it reads like prose and is long enough.", "Short.",
           "Another paragraph with a <a href='/x'>link</a> in the middle of it, and enough text around the link to be prose all the same."]
CLEAN = [ARTICLE[0], "The first paragraph goes on for a while, with bold words & signs, so that it reads like prose and is long enough.", "Short.",
         "Another paragraph with a link in the middle of it, and enough text around the link to be prose all the same."]
JUNK = [
    '<nav><ul><li><a href="/">Home</a></li><li><a href="/a">All our stories</a></li></ul></nav>', '<header><p>The best site of the whole wide web, since 1999.</p></header>',
    '<aside class="sidebar"><h2>Popular</h2><p>Read this other story about something else entirely, it is long.</p></aside>', '<div class="cookie-notice"><p>We use cookies to make this site better for everyone who comes here.</p></div>',
    '<div id="ad-1">Buy things now, they are cheap and good and will last you for years.</div>', '<form><label>Name</label><input name=q><button>Send</button></form>',
    '<section id="comments"><p>I liked this article very much, and I wrote a long comment to say that I did.</p></section>', "<script>var x = '<p>no</p>';</script>", "<style>p{}</style>",
    '<footer>&copy; 2024 The site. All rights reserved, and so on.</footer>', '<p style="display: none">Hidden words that no reader ever sees on the page.</p>', "<!-- <p>gone</p> -->", "<textarea>typed</textarea>", "<noscript><p>Please switch scripts on.</p></noscript>",
]


def body():
    return f"<h1>{ARTICLE[0]}</h1>" + "".join(f"<p>{x}</p>" for x in ARTICLE[1:])


def test_articles_are_found_among_junk():
    rnd = random.Random(3)
    for wrap in ("<article>{}</article>", "<main><div class='content'>{}</div></main>", "<div id='main-content'>{}</div>", "<div><div>{}</div></div>"):
        for _ in range(6):
            junk = rnd.sample(JUNK, len(JUNK))
            k = rnd.randint(0, len(junk))
            page = "<html><head><title>T</title></head><body>" + "".join(junk[:k]) + wrap.format(body()) + "".join(junk[k:]) + "</body></html>"
            assert extract.main_text(page).split("\n") == CLEAN, page


def test_junk_inside_the_article_goes():
    page = f"<article><h1>{ARTICLE[0]}</h1><p>{ARTICLE[1]}</p>{JUNK[4]}<p>{ARTICLE[2]}</p>{JUNK[6]}<p>{ARTICLE[3]}</article>"
    assert extract.main_text(page).split("\n") == CLEAN


def test_odd_markup():
    text = extract.main_text
    assert text("") == text("<html></html>") == text("<p></p>") == text("<script>x") == ""
    assert text("<article><p>one<p>two<ul><li>three<li>four</ul><p>a < b, c&lt;d &nbsp;e\n\t f</article>") == "one\ntwo\nthree\nfour\na < b, c<d e f"
    assert text("<article><p><b>open<br>still<p>next</b></article>") == "open still\nnext"
    assert text('<article><p title="a>b">x</p><p class=\'q">y</p></article>').startswith("x")


def test_raw_elements_end_at_their_own_end_tag():
    text = extract.main_text
    for raw in ("<script>for(i=0;i<n;i++){f(i);}</script>", "<script>if (a<b) x = '<!--';</SCRIPT >", "<style>a<b{}</style>", "<title>1<2</title>",
                "<textarea>a <b</textarea>", "<script>x = '</scripted>';</script>"):
        for page in (f"<body>{raw}<article>{body()}</article></body>", f"<article>{raw}{body()}</article><script>g()</script>"):
            assert text(page).split("\n") == CLEAN, page


def test_an_open_head_ends_where_the_body_begins():
    for head in ("<head><title>T</title><meta charset=utf-8>", "<head><script>x<y</script><link rel=a>", "<head><template><p>no</p></template>", "<head>"):
        for start in ("<body>", "", "<BODY class=x>"):
            assert extract.main_text(f"<html>{head}{start}<article>{body()}</article>").split("\n") == CLEAN
    assert extract.main_text("<head><title>T</title>A sentence of some length that stands in no element, and ends with a stop, all by itself.").startswith("A sentence")
    assert extract.main_text("<head><template><p>A sentence of some length that no reader sees, for it is only a template of others.</p></template></head>") == ""


def test_wrapped_pages_keep_their_article():
    for start, end in (("<form action=/ method=post><div>", "</div></form>"), ("<div class='widget'>", "</div>"), ("<div class='has-sidebar'>", "</div>"), ("<div class='overlay'><form>", "</form></div>"),
                       ("<div class='post comments-open'>", "</div>"), ("<div class='widget-content'>", "</div>"), ("<div class='content widget'>", "</div>"), ("<div id='content-sidebar-wrap'>", "</div>")):
        for inner in ("<article>{}</article>", "<main>{}</main>", "<div role='main'>{}</div>"):
            for junk in ("", JUNK[0] + JUNK[2], JUNK[6] + JUNK[9], JUNK[3] + JUNK[4]):
                page = f"<body class='has-sidebar no-js comments-open widget'>{start}{inner.format(body())}{junk}{end}</body>"
                assert extract.main_text(page).split("\n") == CLEAN, page
    assert extract.main_text(f"<body id='widget'><form>{body()}{JUNK[6]}</form></body>").split("\n") == CLEAN
    widgets = "".join(f"<div class='elementor-widget'><p>{x}</p></div>" for x in [ARTICLE[3]] * 8)
    assert extract.main_text(f"<body class='page'>{JUNK[0]}{widgets}{JUNK[9]}</body>").split("\n") == [CLEAN[3]] * 8


def test_junk_beside_an_article_stays_junk():
    long = "<p>I liked this very much, and I wrote a long comment to say so, which goes on and on for quite a while, as such comments do.</p>"
    for junk in (f"<section id='comments'>{long * 30}</section>", f"<ol class='comment-list'><li class='comment'><article class='comment-body'>{long * 9}</article></ol>",
                 f"<aside><article>{long}</article><article>{long}</article></aside>", f"<div class='post-comments'>{long * 5}</div>", f"<div aria-label='Comments on this post'>{long}</div>"):
        for wrap in ("<article>{}</article>", "<div>{}</div>", "<form><main>{}</main></form>", "<form><div>{}</div></form>"):
            assert extract.main_text(f"<body class='single'>{wrap.format(body() + junk)}</body>").split("\n") == CLEAN
            assert extract.main_text(f"<body class='single'>{wrap.format(body())}{junk}</body>").split("\n") == CLEAN
    assert extract.main_text(f"<body><footer><p>{ARTICLE[3]}</p></footer><div class='cookie-notice'>{long}</div></body>") == ""


@given(st.text(alphabet="<>/pabdivscript=\"' !-&;x", max_size=60))
@settings(max_examples=150, deadline=None)
def test_nothing_breaks_it(html):
    assert "\n\n" not in extract.main_text(html)


def test_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", f"<article>{body()}</article>"), (3, "u", "<article><p>" + "long text. " * 40_000 + "</p></article>"), (3, "u", "<p>")]
    got = extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS blocks")).collect()
    assert len(got) == 5 and {r["page_id"]: r["text"] for r in got}[None] == "\n".join(CLEAN)
    assert max(len(r["text"]) for r in got) == 11 * 40_000 - 1
    assert extract.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def seconds(html):
    start = time.process_time()
    extract.main_text(html)
    return time.process_time() - start


@pytest.mark.parametrize("make", [
    lambda n: '<a "' * n, lambda n: "<a '\"" * n, lambda n: "<a " * n, lambda n: "<a<" * n + ">", lambda n: "<!" * n, lambda n: "<b>" * n + "</p>" * n, lambda n: "<b>" * n + "<p></p>" * n,
    lambda n: "<ul><li><ul>" + "<b>" * n + "<li></li>" * n, lambda n: "<div class=content>word " * n, lambda n: "<nav><div class=content>word " * n, lambda n: "<header>" * n, lambda n: "<" * n,
])
def test_odd_pages_take_time_in_proportion(make):
    seconds(make(2_000))
    assert seconds(make(40_000)) < 5 * max(seconds(make(20_000)), 0.05)


def test_quotes_and_open_ends():
    assert extract.main_text('<p title="a > b">One.</p><p title=\'"\'>Two.</p>') == "One.\nTwo."
    assert extract.main_text('<p title="open>One.</p><p>Two.</p>') == "One.\nTwo."
    assert extract.main_text("One <b two") == "One <b two" and extract.main_text("a < b > c") == "a < b > c"


def test_a_page_without_junk_is_kept_however_short():
    assert extract.main_text("Just a line.") == "Just a line." and extract.main_text("<p>ok") == "ok"
    assert extract.main_text("<title>x</title><body><div>one</div><div>two</div>") == "one\ntwo"
    assert extract.main_text("<nav>menu</nav>") == ""
