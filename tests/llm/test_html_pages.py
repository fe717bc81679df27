"""Operator 10 against a plain block splitter, on broken pages, and on pages of layouts that its labelled table does not hold."""

import random
import time
from html.parser import HTMLParser

import pytest

from lodestone.llm import html_text

WORDS = "river stone and the of a market winter under light paper glass orange &amp; caf&eacute; x&#8217;s".split()


def words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def links(rng, n, most=3):
    return "".join(f'<li><a href="/{i}">{words(rng, rng.randint(1, most))}</a></li>' for i in range(n))


class Plain(HTMLParser):
    """Blocks of a well-formed page, a character after the other."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.held, self.skip = [], [], 0

    def flush(self):
        if text := " ".join("".join(self.held).split()):
            self.out.append(text)
        self.held = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head"):
            self.skip += 1
        elif tag == "br":
            self.held.append(" ")
        elif tag in html_text.BLOCKS:
            self.flush()

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head"):
            self.skip -= 1
        elif tag in html_text.BLOCKS:
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.held.append(data)


def tree(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice([words(rng, rng.randint(0, 9)), "<br>", f"<b>{words(rng, 2)}</b> {words(rng, 3)}", f'<a href="x>y">{words(rng, 2)}</a>', "<!-- <p>no</p> -->", "<script>if (a < b) '<p>'</script>", "  \n\t ", "1 < 2 &lt; 3"])
    tag = rng.choice(["div", "section", "ul", "article", "blockquote", "table", "h2", "header", "span", "em"])
    return f'<{tag} class="c{depth}">' + "".join(tree(rng, depth - 1) for _ in range(rng.randint(1, 4))) + f"</{tag}>"


@pytest.mark.parametrize("seed", range(60))
def test_blocks_are_those_of_a_plain_splitter(seed):
    rng = random.Random(seed)
    page = f"<!DOCTYPE html><html><head><title>{words(rng, 3)}</title><style>p > a</style></head><body>{''.join(tree(rng, 5) for _ in range(4))}</body></html>"
    plain = Plain()
    plain.feed(page)
    plain.close()
    plain.flush()
    assert [b[0] for b in html_text.blocks(page)] == plain.out


@pytest.mark.parametrize("page,text", [
    ("<html><head><title>T</title><body><article><p>Hello world</article>", "Hello world"),
    ("<html><head><title>T</title><meta x><p>one two three four five six seven eight nine ten eleven", "one two three four five six seven eight nine ten eleven"),
    ("<head><title>T</title>stray<body><main>text", "text"),
    ("<article><p title='a > b' data-x=\"it's\">kept</p><p title=\"never closed>also kept</p></article>", "kept\n\nalso kept"),
    ("<article><svg/><p>after</p></article>", "after"),
    ("<article><p>before<script>var x = 1;", "before"),
    ("<article>a < b > c &lt;d&gt; &#233;&eacute;&#x1F600;</article>", "a < b > c <d> éé😀"),
])
def test_broken_pages(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("page", ["<script " * 100_000, "<div>" * 100_000 + "</p>" * 100_000, '<a href="' * 100_000, "<!" * 100_000, "<article>" + "<div>" * 50_000 + "</section>" * 50_000, '<a "' * 100_000 + ">", "<" * 200_000 + ">", "<p a='\">" * 50_000, "&amp" * 100_000])
def test_scanning_is_linear(page):
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 3


def article(rng):
    """(html, texts) of an article's inside."""
    import html

    out, texts = [], []
    for _ in range(rng.randint(2, 7)):
        t = words(rng, rng.choice([1, 4, 20, 35, 60, 90]))
        linked = f'<a href="/x">{words(rng, 2)}</a>' if rng.random() < 0.3 else ""
        texts.append(" ".join(html.unescape(f"{t} {linked[13:-4]}").split()))
        out.append(f"<p>{t} {linked}</p>")
    title = words(rng, rng.randint(3, 9))
    return f"<h1>{title}</h1>{''.join(out)}", [html.unescape(title), *texts]


def dense(rng):
    import html

    ts = [words(rng, rng.choice([18, 35, 60, 90])) for _ in range(rng.randint(3, 7))]
    title = words(rng, rng.randint(3, 9))
    return f"<h2>{title}</h2>" + "".join(f"<p>{t}</p>" for t in ts), [html.unescape(x) for x in (title, *ts)]


def around(rng, inner, kind):
    menu, foot = links(rng, rng.randint(4, 9)), f"&copy; {words(rng, 3)}"
    note, talk = words(rng, rng.randint(3, 25)), "".join(f"<p>{words(rng, 40)}</p>" for _ in range(3))
    return {
        "main": f"<nav><ul>{menu}</ul></nav><div class='cookie-notice'>{note}</div><main>{inner}</main><aside>{note}</aside><footer>{foot}</footer>",
        "named": f"<div id='top-menu'><ul>{menu}</ul></div><div class='article-body'>{inner}</div><div class='comments'>{talk}</div><div class='site-footer'>{foot}</div>",
        "ads in it": f"<header>{note}</header><article>{inner}<div class='advert'>{note}</div><form>{note}<input></form></article><section id='comments'>{talk}</section>",
        "bare": f"<ul>{menu}</ul>{inner}<ul>{links(rng, rng.randint(5, 9))}</ul>",
        "table": f"<table><tr><td><ul>{menu}</ul></td><td>{inner}</td></tr></table><div>{links(rng, 6, 5)}</div>",
    }[kind]


def right(kind, seeds):
    """Shares of texts found that are main text, and of main texts that are found."""
    found = wanted = both = 0
    for seed in seeds:
        rng = random.Random(f"{kind}{seed}")
        inner, texts = (dense if kind in ("bare", "table") else article)(rng)
        got = html_text.main_text(f"<html><head><title>{words(rng, 3)}</title></head><body>{around(rng, inner, kind)}</body></html>").split("\n\n")
        found, wanted, both = found + len(got), wanted + len(texts), both + sum(t in got for t in texts)
    return both / found, both / wanted


@pytest.mark.parametrize("kind,least", [("main", 0.98), ("named", 0.98), ("ads in it", 0.98), ("bare", 0.97), ("table", 0.97)])
def test_pages_of_other_layouts(kind, least):
    precision, recall = right(kind, range(100))
    assert precision >= least and recall >= least


TITLE = "<h1>A title of some words</h1>"
BODY = f"{TITLE}<p>{'word ' * 35}</p><p>{'more ' * 50}</p>"
MENU = "<ul>" + "<li><a href='/x'>go here</a></li>" * 6 + "</ul>"
TALK = f"<p>{'talk ' * 60}</p>" * 3


@pytest.mark.parametrize("page", [
    f'{MENU}<article class="post-12 comments-open">{BODY}</article>',
    f'<div class="page has-footer">{MENU}<div>{BODY}</div></div>',
    f'<div class="menu-closed">{MENU}<main>{BODY}</main></div>',
    f'{MENU}<div class="layout navigation-left"><div class="story">{BODY}</div></div>',
    f'{MENU}<div class="form-factor">{BODY}</div>',
    f'<div class="sidebar-right"><div class="menu">{MENU}</div><article>{BODY}</article></div>',
    f'{MENU}<div class="widget">{BODY}</div><div class="advert">{MENU}</div>',
    f'<div class="modal"><main class="header-2">{BODY}</main></div>',
    f'<nav>{MENU}</nav><div class="no-comments banner-off">{BODY}</div><footer>words here</footer>',
    f'<form id="aspnetForm">{MENU}<div class="content">{BODY}</div><div class="comments">{TALK}</div></form>',
    f'<div class="entry">{BODY}</div><div id="comments" class="comments-area"><article class="comment">{TALK}</article></div>',
    f'{BODY}<section class="discussion">{TALK}</section>',
])
def test_misleading_marks(page):
    """Names of states, in passing, or of containers around the article: the article stays, and nothing else does."""
    got = html_text.main_text(f"<html><body>{page}</body></html>").split("\n\n")
    assert [len(t.split()) for t in got] == [5, 35, 50]


def test_marks_are_overruled_both_ways():
    """A long text without links stays in a loose container; a short list of links goes from a container with a good name."""
    page = f'{MENU}{TITLE}<p>{"word " * 40}</p><div class="promo"><p>{"long " * 150}</p></div><div class="promo"><p>buy this now</p></div>'
    assert [len(t.split()) for t in html_text.main_text(page).split("\n\n")] == [5, 40, 150]
    page = f'<div class="content">{TITLE}<p>{"word " * 40}</p>{MENU}</div>'
    assert [len(t.split()) for t in html_text.main_text(page).split("\n\n")] == [5, 40]


def test_tree_rests_on_counts_and_evidence():
    """Over combinations of words, links and neighbours each grade of evidence but readers' talk both keeps and drops blocks."""
    kept = {grade: set() for grade in [(2, 0), (1, 0), (0, 0), (0, 1), (0, 2)]}
    for good, bad in kept:
        for words in (1, 4, 12, 40, 90, 200, 400):
            for density in (0, 0.3, 0.8, 1):
                row = [words, density, 3, 0.5, 3, 0.5, good, bad, 0]
                kept[good, bad].add(html_text._keeps(html_text.tree(), row))
    assert all(kept[g] == {True, False} for g in [(1, 0), (0, 0), (0, 1), (0, 2)]) and kept[2, 0] == {True}
    assert sum(len(p) for p in html_text.labelled()) > 400


def test_pages_and_odd_columns(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "y"), (None, "u", "<article>kept</article>", "z"), (4, "u", "<article><p>" + "wort " * 200_000, "z"), (4, "u", "<article>kept</article>", "z"), (4, "u", "<article>kept</article>", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(pages).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, 4, 4, 4, 999_999] and all(len(r["text"]) == r["n_chars"] for r in got)
    assert html_text.extract(pages.limit(0)).collect() == []
