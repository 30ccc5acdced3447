import re
from html import unescape

import pytest

from vellum.llm.main_text import extract_main_text, main_text

P = ["A first paragraph, long enough to be told from a menu by its text alone, and then some.", "Short one.", "The third is again a paragraph with &amp; and &eacute;, many words in a row, as articles have."]
ARTICLE = "<h1>Head line</h1>" + "".join(f"<p>{p}" for p in P)
WANT = "\n".join(["Head line", *map(unescape, P)])
MENU = "<nav><ul>" + "".join(f"<li><a href='/{k}'>Menu {k}</a></li>" for k in range(8)) + "</ul></nav>"

PAGES = {
    "plain": f"<html><head><title>t</title><style>p{{}}</style><script>var x='</p>';</script></head><body>{MENU}<div class='ad'>Buy this now</div><article>{ARTICLE}</article><footer>&copy; x</footer></body></html>",
    "sidebar": f"<body>{MENU}<main><article>{ARTICLE}</article></main><aside><p>{P[0]}</p></aside><footer>x</footer>",
    "comments": f"<body><header><h1>Site</h1></header><article>{ARTICLE}</article><section id='comments'><article class='comment'><p>{P[0]}</p></article></section>",
    "inside": f"<body><article>{ARTICLE}<div class='related'><a href='/'>More</a></div><form><label>Mail</label><button>Go</button></form><div class='cookie-notice'>We use cookies on this site, as all do.</div></article>",
    "divs": f"<body><div id='nav'><a href='/a'>One</a> <a href='/b'>Two</a></div><div id='content'>{ARTICLE}</div><div class='footer'>Bottom</div>",
    "unclosed menu": f"<body><nav><a href='/a'>One</a><article>{ARTICLE}</article><footer>x</footer>",
    "nested": f"<body><div><div><section><div>{ARTICLE}</div></section></div></div><div class='sidebar'><ul><li>x</li></ul></div>",
    "upper case": f"<BODY>{MENU.upper()}<ARTICLE>{ARTICLE.replace('<p>', '<P>')}</ARTICLE></BODY>",
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    assert main_text(PAGES[name]) == WANT


@pytest.mark.parametrize("html", [None, "", "   ", "<nav>x</nav>", "<script>1</script>", "<!-- only -->"])
def test_no_text(html):
    assert main_text(html) == ""


def test_white_space_and_entities():
    assert main_text("<article><p>a\n b&nbsp;&#x41;<b>c</b><br>d</p><p> </p><p>&lt;e&gt;</p></article>") == "a b Ac d\n<e>"


@pytest.mark.parametrize("element", ["<script src=x></script>", "<script>var a = 1</script>", "<button>Copy</button>", "<svg><text>logo</text></svg>", "<iframe src=x></iframe>", "<select><option>x</option></select>", "<span class=ad>Buy</span>", "<noscript>off</noscript>"])
def test_excluded_elements_within_a_line(element):
    assert main_text(f"<article><p>{P[0]} {element} and more</p><p>{P[1]}</p></article>") == f"{P[0]} and more\n{P[1]}"
    assert main_text(f"<div>{P[0]}{element} and more</div>") == f"{P[0]} and more"


LONG = " ".join(f"{P[0]} {k}." for k in range(40))
LONG_PARTS = {
    "pre": f"<pre>{LONG}</pre>",
    "li": f"<ul><li>{LONG}</li><li>x</li></ul>",
    "blockquote": f"<blockquote>{LONG}</blockquote>",
    "td": f"<table><tr><td>{LONG}</td></tr></table>",
    "dd": f"<dl><dd>{LONG}</dd></dl>",
    "section": f"<section>{LONG}</section>",
    "div": f"<div class=body><p>{LONG}</p></div>",
}


@pytest.mark.parametrize("part", LONG_PARTS)
@pytest.mark.parametrize("around", ["<div class=post>{}</div>", "{}", "<div id=page><nav><a href=/>Home</a></nav><div class=post>{}</div></div>", "<nav><a href=/>Home</a></nav>{}<footer>x</footer>", "<div><a href=/>Home</a> <a href=/a>A</a></div><div class=post>{}</div>"])
def test_one_long_part_does_not_end_the_region(part, around):
    html = f"<body>{around.format(f'<h1>Head line</h1><p>Lead.</p>{LONG_PARTS[part]}<p>End.</p>')}</body>"
    assert main_text(html) == "\n".join(["Head line", "Lead.", LONG, *(["x"] if part == "li" else []), "End."])


WRAPPERS = {
    "has": f"<div class='content has-sidebar'><article>{ARTICLE}</article></div>",
    "with": f"<div id='page-with-sidebar'>{ARTICLE}</div>",
    "main": f"<main class='with-sidebar'>{ARTICLE}</main>",
    "no": f"<div class='no-comments'>{ARTICLE}</div>",
    "layout": f"<div class='sidebar-layout'>{ARTICLE}<div class='sidebar'><p>{P[0]}</p></div></div>",
    "main layout": f"<nav><a href='/'>x</a><main class='sidebar-layout'>{ARTICLE}</main>",
    "inline": f"<x-page class='search-page'><div>{ARTICLE}</div></x-page>",
    "talk": f"<div class='discussion'><article>{ARTICLE}</article><div class='comment'><p>{P[0]}</p></div></div>",
    "post-header": f"<article><div class='post-header'><h1>Head line</h1><p>By someone</p></div>{ARTICLE[18:]}</article>",
    "post-header of a div": f"<div id=content><div class='entry-header'><h1>Head line</h1></div>{ARTICLE[18:]}</div>",
}


@pytest.mark.parametrize("name", WRAPPERS)
def test_names_of_wrappers_exclude_nothing(name):
    assert main_text(f"<body>{MENU}{WRAPPERS[name]}<div class='footer'>Bottom</div></body>") == WANT


@pytest.mark.parametrize("talk", ["<section id='comments'>{}</section>", "<div class='replies'>{}</div>"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_long_comments_stay_out(tag, talk):
    comments = "".join(f"<article class='comment'><p>{P[0]} {k}</p></article>" for k in range(30))
    assert main_text(f"<body>{MENU}<{tag}>{ARTICLE}</{tag}>{talk.format(comments)}</body>") == WANT


def test_generated_pages_against_their_articles(spark, small):
    got = {r.page_id: r for r in extract_main_text(spark.read.parquet(f"{small}/pages.parquet")).collect()}
    for page_id, url, html in spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html").collect():
        article = re.search(r"<article>(.*)</article>", html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert (got[page_id].text, got[page_id].n_chars, got[page_id].url) == (want, len(want), url)


def test_edge_rows(spark):
    rows = [(1, "u", None, 1), (1, "u", None, 1), (None, None, "<p>x</p>", 2), (2, "v", "<p>" + "w " * 200_000, 3)]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 1, 399_999]
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


MENU = "".join(f"<p><a href=/x{k}>t{k}</a> <b>u{k}</b> <i>v{k}</i></p>" for k in range(8))


@pytest.mark.parametrize("page", ["<body><div>{menu}</div><div id=c>{text}</div><div>{menu}</div></body>", "<body>{menu}{text}{menu}</body>", "<body><div class=x>{menu}</div><div class=y>{text}</div><div class=z>{menu}</div></body>"])
def test_ratios_choose_the_region(page, monkeypatch):
    """No name, sectioning element or line of links tells menu from text here; with flat ratios the menus stay."""
    from vellum.llm import main_text as module

    html = page.format(menu=MENU, text=f"<h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p><p>End.</p>")
    want = "\n".join(["Title", LONG, "Short.", LONG, "End."])
    assert main_text(html) == want
    monkeypatch.setattr(module, "_high", lambda ratios: ratios > 0)
    assert main_text(html) != want


@pytest.mark.parametrize("name", ["notice-board", "comment-page", "footer-less", "ad-hoc"])
def test_odd_names_around_an_article(name):
    assert main_text(f'<body><div id="{name}"><article><h1>Title</h1><p>{LONG}</p></article></div></body>') == f"Title\n{LONG}"
