import random
import re
from html import unescape

import numpy as np
import pytest

from threadlens.llm.html_text import FEATURE_NAMES, LEAD, WEIGHTS, Tree, blocks, extract, extract_pages, features, labelled_pages, labelled_table, trained

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><a href=/>Site</a><p>Our motto is here</p></header><nav><ul><li><a>Home</a><li><a>About us</a></ul></nav>
<div class="cookie-notice">We use cookies and other things on this page, please accept them all</div>
<article><h1>A &lt;title&gt; &amp; more</h1><p><b>First   line<br>
goes on</b><p>Second&nbsp;one<!-- hidden --></p><div class="ad-box advert">Buy this now, it is very cheap and good</div>
<p>One.</p><form>Name <input name=x><button>Send</button></form><ul><li>item <a href=x>link</a> text</li></ul></article>
<aside><p>Other stories that you may like to read today on this site</p></aside>
<section id="comments"><h3>Comments</h3><p>What a great article, I learned so much from it, thank you!</p></section>
<footer>&copy; 2020 somebody</footer></body></html>"""


def test_page():
    assert extract(PAGE) == "A <title> & more\nFirst line goes on\nSecond one\nOne.\nitem link text"


def test_tree_fits_its_table():
    x, y = labelled_table()
    assert (trained().predict(x) == y).all() and 0.3 < y.mean() < 0.8


def test_without_article_tags():
    body = "".join(f"<p>{'word ' * n}</p>" for n in (30, 45, 60))
    page = f"<div><a>one</a></div><div><a>two three</a></div>{body}<div><a>more</a> <a>links here</a></div>"
    assert extract(page) == "\n".join(" ".join(["word"] * n) for n in (30, 45, 60))


def test_odd_markup():
    for page in ("", "   ", "<", "<<<>>", "<p", "&amp", "</div></p>", "<script>never closed", "<a><a><a>", "<p>" * 3000, "<!--", "<article>" + "x " * 200_000):
        extract(page)
    assert extract("<article><p>a < b && c</p>") == "a < b && c"
    assert extract("<article><p>cut off") == "cut off"
    assert [b[0] for b in blocks("<td>a<td>b<p>c")] == ["a", "b", "c"]


def test_pages(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars string"
    rows = [(1, "u", PAGE, "t", "n"), (1, "u", PAGE, "t", "n"), (2, None, None, None, None), (None, "v", "", None, None)]
    got = sorted(map(tuple, extract_pages(spark.createDataFrame(rows, schema)).collect()), key=str)
    text = extract(PAGE)
    assert got == sorted([(1, "u", text, len(text))] * 2 + [(2, None, "", 0), (None, "v", "", 0)], key=str)
    assert extract_pages(spark.createDataFrame([], schema)).collect() == []


def test_reading_is_linear():
    import time

    began = time.time()
    for page in ("<a " * 50_000, '<a "' * 50_000, "<!--" * 50_000, "<div>" * 20_000 + "</p>" * 50_000, "<a " + "b='c' " * 50_000 + ">", "<script>" + "<" * 200_000, "<" * 100_000, "&lt;" * 100_000):
        extract(page)
    assert time.time() - began < 20


def test_boilerplate_by_name():
    for mark in ("class=commentlist", "id='adBox'", 'class="page sidebar-left"', "role=navigation", "hidden", "style='display: none'", "aria-hidden=true", "class='cookieBar'"):
        assert extract(f"<article><p>kept</p><div {mark}><p>dropped words of some length that would pass as prose elsewhere</p></div><p>too</p></article>") == "kept\ntoo", mark
    assert extract("<head><title>no</title><p>the head ends here") == "the head ends here"


@pytest.mark.parametrize("mark", ['div id="main" class="has-sidebar"', 'div class="content no-sidebar"', 'div class="entry tags-news"', 'section class="post modal-open"', "form><article", "article"])
def test_names_of_states_do_not_drop_an_article(mark):
    long, short = " ".join(["word"] * 40), "Only five words are here"
    page = f"<nav><a>Home</a></nav><{mark}><h2>Short title</h2><p>{long}</p><p><a>See this too</a></p><h3>Short</h3><p>{short}</p><p><a>one</a> <a>two</a></p><p>{long}</p></{mark.split('<')[-1].split()[0]}>"
    assert extract(page) == "\n".join(["Short title", long, "See this too", "Short", short, "one two", long])


def test_new_pages_of_the_rule():
    """Pages drawn with other seeds: blocks inside an article's element are never dropped, others seldom misjudged."""
    for seed in (101, 102, 103):
        pages = labelled_pages(300, seed)
        x, y = labelled_table(300, seed)
        got = trained().predict(x)
        inside = (x[:, FEATURE_NAMES.index("in_content")] == 1) & (x[:, 7:10].sum(1) == 0)
        assert inside.sum() > 1000 and got[inside].all() and (got == y).mean() >= 0.995
        # The whole way, against the words that the rule put into the article.
        wrong = sum(extract(p).count("-") > 0 or len(extract(p)) and extract(p).split().count("+") != unescape(re.sub("<[^>]*>", " ", p)).split().count("+") for p in pages)
        assert wrong <= 12


def test_neighbours_lead_the_tree():
    tree, led = trained(), []
    level = [tree]
    for _ in range(LEAD):
        led += [FEATURE_NAMES[t.feature] for t in level if t.feature is not None and WEIGHTS[t.feature] == 1.0]
        level = [s for t in level if t.feature is not None for s in (t.low, t.high)]
    assert any("before" in f or "after" in f for f in led) and "link_density" in led


def test_features_match_brute_force():
    rng = random.Random(3)
    found = [("t", rng.randint(1, 90), rng.random(), *(rng.randint(0, 1) for _ in range(6))) for _ in range(40)]
    for n in (0, 1, 2, 40):
        want = [[*found[k][1:3], *(found[k - 1][1:3] if k else (0, 0)), *(found[k + 1][1:3] if k + 1 < n else (0, 0)), *found[k][3:]] for k in range(n)]
        assert features(found[:n]).tolist() == np.array(want, float).reshape(n, 12).tolist()


def brute_tree(x, y, lead):
    """(feature, cut) of the best split over all features and all cuts, counted one row at a time."""
    def impure(part):
        return 2 * sum(part) * (len(part) - sum(part)) / len(part) if part else 0.0

    best = None
    for f in range(len(x[0])):
        values = sorted({r[f] for r in x})
        for a, b in zip(values, values[1:]):
            gain = impure(y) - impure([v for r, v in zip(x, y) if r[f] <= (a + b) / 2]) - impure([v for r, v in zip(x, y) if r[f] > (a + b) / 2])
            gain *= WEIGHTS[f] if lead > 0 else 1
            if gain / len(y) > (best[0] if best else 1e-9) + 1e-12:
                best = (gain / len(y), f, (a + b) / 2)
    return best and best[1:]


def test_tree_matches_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(12):
        x = rng.integers(0, 5, (30, 12)).astype(float)
        y = (x[:, 0] + x[:, 3] + 3 * x[:, 7] + rng.integers(0, 4, 30)) > 9
        todo = [(Tree(x, y), x, y, LEAD)]
        while todo:
            tree, a, b, lead = todo.pop()
            if b.all() or not b.any():
                assert tree.feature is None and tree.answer == b[0]
                continue
            want = brute_tree(a.tolist(), b.tolist(), lead)
            assert (want is None and tree.feature is None) or (tree.feature, tree.cut) == want
            if want:
                left = a[:, want[0]] <= want[1]
                todo += [(tree.low, a[left], b[left], lead - 1), (tree.high, a[~left], b[~left], lead - 1)]


LONG = " ".join(["word"] * 60)


@pytest.mark.parametrize("outer", [
    "div class=content-sidebar-wrap", "div class=main-with-sidebar", "div class=wrap-sidebar-right", "div class=layout-with-sidebar", "section class=copyright-law", "div class=legal-news", "div class=post-meta-wrapper",
    *(f"div class={a}-{b}" for a in ("page", "outer", "site", "layout", "wrapper") for b in ("sidebar", "meta", "banner", "nav", "widget", "related", "social")),
    "div class='two-columns sidebar-left-layout'", "div id=navbarPageWrap", "div class=promo-page", "section id=login-help", "div class=adslot-article",
    "form", "form class=page-form", "form><div", "form action=x id=aspnetForm",
])
@pytest.mark.parametrize("inner", ["", "<div class='article-body'>", "<article>"])
def test_outer_wrappers_do_not_drop_an_article(outer, inner):
    close = f"</{inner[1:].split()[0].rstrip('>')}>" if inner else ""
    ends = "".join(f"</{t.split()[0]}>" for t in reversed(outer.split("><")))
    links = "<div class=menu><a>one</a> <a>two</a></div>"
    page = f"{links}<{outer}>{inner}<p>{LONG}</p><p>{LONG}</p>{close}{ends}<footer>the end of it</footer>"
    assert extract(page) == f"{LONG}\n{LONG}"


def test_names_inside_an_article_drop_little_and_comments_go_whatever_their_length():
    assert extract(f"<article class='post legal-news'><p>{LONG}</p><p>short</p></article>") == f"{LONG}\nshort"
    many = "".join(f"<p>{LONG}</p>" for _ in range(9))
    for mark in ("section id=comments", "div class=comment-list", "div class=user-comments", "div class='post-comments wide'", "aside"):
        page = f"<article><h1>Title</h1><p>{LONG}</p></article><{mark}>{many}</{mark.split()[0]}>"
        assert extract(page) == f"Title\n{LONG}", mark
    assert extract(f"<article><p>{LONG}</p><div class='ad-box'><p>buy this and that</p></div><p>{LONG}</p></article>") == f"{LONG}\n{LONG}"
    assert extract(f"<div class=sidebar-left><p>{LONG}</p><p>{LONG}</p></div><main><p>{LONG}</p></main>") == LONG


def test_formulas_and_short_lines_stay():
    assert extract(f"<article><p>{LONG}</p><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds</p></article>") == f"{LONG}\nso x=1 holds"
    assert extract("<h1>A title of five words</h1><p>only four words here</p><p>three more words</p>") == "A title of five words\nonly four words here\nthree more words"
    assert extract("<div>alone</div>") == "alone"
