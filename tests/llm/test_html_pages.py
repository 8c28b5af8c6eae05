"""Whole pages: names never cost an article, page types have their own templates, reposts are no template."""

import random

import pytest

from sqltally.llm import html_extract


def text_of(html):
    return html_extract.content(html, {}, frozenset())


@pytest.mark.parametrize(
    "html, want",
    [
        ('<body class="has-sidebar"><article><p>abc def</p></article></body>', "abc def"),
        ('<body><article class="post has-comments"><p>abc def</p></article></body>', "abc def"),
        ('<body><main id="search-page"><p>abc def</p></main></body>', "abc def"),
        ("<body><article><header><h1>Title</h1></header><p>abc def</p></article></body>", "Title\nabc def"),
        ('<body><div class="content with-sidebar"><p>abc def</p></div><div class="sidebar"><p>side</p></div></body>', "abc def"),
        ('<form id="all"><div class="widget"><article><p>abc def</p></article></div></form>', "abc def"),
        ('<body><article><p>abc def</p><div class="comment-list"><p>me too</p></div></article><footer>end</footer></body>', "abc def"),
        ('<body><div class="menu"><p>only this</p></div></body>', "only this"),
    ],
)
def test_names_never_veto_the_article(html, want):
    assert text_of(html) == want


def words(rng, n):
    return " ".join(rng.choice("sun moon tree river stone cloud field house road wind".split()) + str(rng.randrange(50)) for _ in range(n))


def texts(spark, pages):
    rows = [(k, "http://host.example/x", html) for k, html in enumerate(pages)]
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    return [r.text for r in sorted(got)]


@pytest.mark.parametrize("second", ["<div><section><div class='top'><p>{n}</p></div><div><p>{b}</p></div></section></div>", "<div class='top'><p>{n}</p></div><div><h2>h</h2><p>{b}</p></div>", "<div class='top'><p>{n}</p></div><div><p>{b}</p></div>", "<div><p>{b}</p></div><div><h3>{n}</h3></div>"])
def test_two_page_types_lose_their_own_notices(spark, second):
    rng = random.Random(1)
    bodies = [words(rng, 60) for _ in range(30)]
    first = "<div class='top'><p>{n}</p></div><div><p>{b}</p></div>"
    shape = [first] * 18 + [second] * 12
    notice = ["Please register for our letter"] * 18 + ["This site uses small files"] * 12
    got = texts(spark, [f"<body>{s.format(n=n, b=b)}</body>" for s, n, b in zip(shape, notice, bodies)])
    for text, body, said in zip(got, bodies, notice):
        assert body in text and said not in text


def test_reposts_keep_their_body(spark):
    rng = random.Random(2)
    body = "</p><p>".join(words(rng, 40) for _ in range(3))
    got = texts(spark, [f"<body><div><h1>Title {k} {words(rng, 3)}</h1><p>{body}</p></div></body>" for k in range(10)])
    assert all(body.split("</p>")[0] in text and f"Title {k}" in text for k, text in enumerate(got))


def test_large_wrappers_are_joined(spark):
    rng = random.Random(3)
    rows = [(k, f"http://h{k % 7}.example/", f"<body><div class='top'><p>Notice of host {k % 7}</p></div><div><p>{words(rng, 50)}</p></div></body>") for k in range(140)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    both = [sorted(html_extract.main_text(pages, broadcast_bytes=n).collect()) for n in (0, 1 << 20)]
    assert both[0] == both[1] and not any("Notice" in r.text for r in both[0])
