"""Main text of web pages: flat text blocks classified by a decision tree.

A page is read once into a flat list of text blocks.  Each block is described
by its word count and link density, those of its neighbours and, as weaker
evidence, by what encloses it: elements and the names their authors gave them.
A name, or a form, says nothing if its element holds most of the page's unlinked
words and no article lies beside it: then it names a layout (content-sidebar-wrap,
legal-news), not boilerplate.  Names that are nothing but a boilerplate word, and
those of comments and consent, need an article inside and all but a tenth of the
words to be set aside like that.
A decision tree, trained on a small labelled table, says which blocks are the
article's.  The table's pages are built by the rule in ``labelled_pages``; a
third of them have no telling element or name at all.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .base import small_batches

# Element names by what they do to the text.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("applet audio button canvas datalist annotation annotation-xml head iframe noembed noframes noscript object script select style svg template textarea title video".split())
BOILER_TAGS = frozenset("aside dialog footer menu nav search".split())
FORM_TAGS = frozenset(["fieldset", "form"])
BOILER_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
BOILER_WORDS = frozenset("ad ads adsense advert advertisement adverts alert banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disclaimer disqus footer gdpr legal login masthead menu meta modal nav navbar navigation newsletter notice overlay pager pagination popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget widgets".split())
BOILER_STEMS = re.compile("comment|advert|sidebar|cookie|newsletter|breadcrumb|footer|masthead|disqus|subscri|sponsor|promo|pagina|banner|widget|ads?(box|slot|unit|space|block|wrap|container|label)")
#: Words of names that speak of readers, never of a layout.
READERS = re.compile("comment|disqus|cookie|consent|gdpr|newsletter|subscri")
CONTENT_TAGS = frozenset(["article", "main"])
CONTENT_WORDS = frozenset("article content entry main post story".split())
#: What a name begins or ends with that tells a state of the page, not what the element holds.
STATES_FIRST = frozenset("has is js no not with without".split())
STATES_LAST = frozenset("active closed disabled enabled hidden off on open".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Pages of the labelled table, and the seed they are drawn with.
TABLE_PAGES, TABLE_SEED = 720, 12
FEATURE_NAMES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "in_content", "in_boiler_element", "in_boiler_name", "content_in_boiler", "in_header", "heading")
#: Levels of the tree, from its root, that words and links lead, and how much a gain by elements and names counts there.
LEAD, WEAK = 2, 0.1
WEIGHTS = (1.0,) * 6 + (WEAK,) * 6


#: A start or end tag; quoted values may hold any mark.  The quantifiers never give back, so a match is linear.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
#: Elements whose contents are characters, not markup, up to their end tag.
RAW_TAGS = frozenset("iframe noembed noframes script style textarea title xmp".split())


class _Page:
    """Reads a page once, front to back, and collects its blocks.

    What encloses a block is a node: an element that says something, with the
    node around it.  Only when all is read, and it is known how many words each
    holds, are they told from layout and added up, once for each node.  A block
    is (text, words, link density, and the last six of FEATURE_NAMES).
    """

    def __init__(self):
        self.found: list[tuple[str, int, float, int]] = []
        self.text: list[tuple[str, bool]] = []
        self.links = self.silent = 0
        self.nodes: list[tuple[int, str, int]] = [(0, "", 0)]  # around, kind, in a heading
        self.words: list[float] = [0.0]  # unlinked words in its own blocks
        self.stack: list[tuple[str, int]] = [("", 0)]
        self.open: Counter = Counter()

    def read(self, page: str) -> list[tuple]:
        at, end = 0, len(page)
        while at < end:
            mark = page.find("<", at)
            if mark < 0:
                self.data(page[at:])
                break
            if mark > at:
                self.data(page[at:mark])
            if tag := _TAG.match(page, mark):
                at, name = tag.end(), tag[2].lower()
                if tag[1]:
                    self.end(name)
                elif name in RAW_TAGS:
                    close = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(page, at)
                    at = close.start() if close else end
                else:
                    self.start(name, tag[3])
            elif page.startswith("<!--", mark):
                close = page.find("-->", mark + 2)
                at = close + 3 if close >= 0 else end
            elif page.startswith(("<!", "<?", "</"), mark):
                close = page.find(">", mark)
                at = close + 1 if close >= 0 else end
            else:
                self.data("<")
                at = mark + 1
        self.flush()
        states = self.states()
        return [(words, n, density, *states[node]) for words, n, density, node in self.found]

    def states(self) -> list[tuple]:
        """For each node: in_content, in_boiler_element, in_boiler_name, content_in_boiler, in_header, heading."""
        held, articles = list(self.words), [int(kind == "content") for _, kind, _ in self.nodes]
        for k in range(len(self.nodes) - 1, 0, -1):  # inner nodes come after those around them
            around = self.nodes[k][0]
            held[around] += held[k]
            articles[around] += articles[k]
        # content, boiler element, boiler name, form, content inside of boilerplate, header, heading, articles around
        out: list[tuple] = [(0, 0, 0, 0, 0, 0, 0, 0)]
        for k, (around, kind, heading) in enumerate(self.nodes[1:], 1):
            content, element, name, form, outer, header, _, above = out[around]
            beside = articles[0] - articles[k] - above
            most = 2 * held[k] > held[0] if kind in ("name", "form") else 10 * held[k] >= 9 * held[0] and articles[k] > 0
            layout = most and not beside and not above  # within an article names mean what they say
            if kind == "content":  # a form may be wrapped round a whole page, so it says nothing of an article in it
                content, element, name, form, outer, above = 1, 0, 0, 0, int(outer or element or name), above + 1
            elif kind == "element":
                element = 1
            elif kind in ("name", "word") and not layout:
                name = 1
            elif kind == "form" and not layout:
                form = 1
            elif kind == "header":
                header = 1
            out.append((content, element, name, form, outer, header, heading, above))
        return [(c, int(e or f), n, o, int(h and not c), g) for c, e, n, f, o, h, g, _ in out]

    def data(self, text: str) -> None:
        if not self.silent:
            self.text.append((text, self.links > 0))

    def flush(self) -> None:
        if self.text:
            words = " ".join(unescape("".join(t for t, _ in self.text)).split())
            if words:
                n = words.count(" ") + 1
                linked = sum(len(t.split()) for t, link in self.text if link)
                node = self.stack[-1][1]
                self.found.append((words, n, min(1.0, linked / n), node))
                self.words[node] += max(0, n - linked)
            self.text = []

    def push(self, tag: str, kind: str) -> None:
        node = self.stack[-1][1]
        heading = int(self.nodes[node][2] or tag in HEADINGS)
        if kind or heading != self.nodes[node][2]:
            self.nodes.append((node, kind, heading))
            self.words.append(0.0)
            node = len(self.nodes) - 1
        self.stack.append((tag, node))
        self.open[tag] += 1
        self.silent += tag in SILENT_TAGS

    def pop(self, tag: str) -> None:
        """Closes the innermost open ``tag`` and all that is open inside it."""
        while self.open[tag]:
            last = self.stack.pop()[0]
            self.open[last] -= 1
            self.silent -= last in SILENT_TAGS
            if last == tag:
                break

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.data(" ")
        elif tag == "a":
            self.links += 1
        elif tag in SILENT_TAGS:
            if not attributes.endswith("/"):
                self.push(tag, "")
        elif tag in BLOCK_TAGS:
            self.flush()
            if self.open["head"]:  # the head ends with the first element of the body
                self.pop("head")
            if self.stack[-1][0] == "p":  # a block ends an open paragraph
                self.pop("p")
            if tag not in VOID_TAGS:
                self.push(tag, _kind(tag, attributes))

    def end(self, tag: str) -> None:
        if tag == "a":
            self.links = max(0, self.links - 1)
        elif tag in BLOCK_TAGS:
            self.flush()
            self.links = 0  # a link that was never closed ends with its block
            self.pop(tag)
        elif tag in SILENT_TAGS:
            self.pop(tag)


def _named(said: dict[str, str]) -> str:
    """What the class and id of an element say: word (of boilerplate), boiler, content, header, or nothing.

    Names are taken whole: one that is a boilerplate word decides; then one that
    is a content word; then names made of several words, but not those that only
    tell a state, such as no-sidebar or modal-open.  Names of several words that
    speak of comments or consent count as one.
    """
    parts = []
    for name in (said.get("class", "") + " " + said.get("id", "")).split():
        spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name)
        parts.append(re.findall(r"[a-z]+", spaced.lower()))
    single = {p[0] for p in parts if len(p) == 1}
    if single & BOILER_WORDS or any(map(BOILER_STEMS.match, single)):
        return "word"
    if single & CONTENT_WORDS:
        return "content"
    several = [p for p in parts if len(p) > 1 and p[0] not in STATES_FIRST and p[-1] not in STATES_LAST]
    if any(w in BOILER_WORDS or BOILER_STEMS.match(w) for p in several for w in p):
        return "word" if any(READERS.match(w) for p in several for w in p) else "boiler"
    if "header" in single or any("header" in p for p in several):
        return "header"
    return "content" if any(w in CONTENT_WORDS for p in several for w in p) else ""


def _kind(tag: str, attributes: str) -> str:
    """What an element says about what it encloses: content, (boilerplate by its) element, name or word, form, header, or nothing."""
    said = {}
    if attributes.strip():
        for name, double, single, bare in _ATTRIBUTE.findall(attributes):
            said.setdefault(name.lower(), unescape(double or single or bare))
    if "hidden" in said or said.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", said.get("style", "")):
        return "element"
    if tag in ("html", "body"):
        return ""
    role = said.get("role", "").lower()
    if tag in BOILER_TAGS or role in BOILER_ROLES:
        return "element"
    if tag in FORM_TAGS:
        return "form"
    named = _named(said)
    if tag in CONTENT_TAGS or role in ("main", "article"):
        return "word" if named == "word" else "content"
    if named in ("word", "boiler"):
        return "name" if named == "boiler" else "word"
    if named == "header" or tag == "header":
        return "header"
    return "content" if named == "content" and tag in ("div", "section", "td") else ""


def blocks(html: str) -> list[tuple]:
    return _Page().read(html)


def features(found: list[tuple]) -> np.ndarray:
    """One row of FEATURE_NAMES for each block; neighbours beyond the page count as empty."""
    own = np.array([b[1:] for b in found], float).reshape(-1, 8)
    pad = np.vstack([np.zeros((1, 8)), own, np.zeros((1, 8))])
    return np.hstack([own[:, :2], pad[:-2, :2], pad[2:, :2], own[:, 2:]])


class Tree:
    """A binary decision tree grown by Gini impurity until its leaves are pure.

    On the first ``lead`` levels a feature's gain counts by its weight; ties go
    to the first feature and the lowest cut.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, weights: tuple[float, ...] = WEIGHTS, lead: int = LEAD, depth: int = 24):
        self.answer, self.feature = bool(2 * y.sum() >= len(y)), None
        if depth == 0 or y.all() or not y.any():
            return
        whole, best = 2 * y.mean() * (1 - y.mean()), (1e-9, None, None)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            at = np.flatnonzero(v[1:] > v[:-1])  # a cut between at and at + 1
            if not len(at):
                continue
            n, p = at + 1.0, ones[at] / (at + 1.0)
            q = (ones[-1] - ones[at]) / (len(y) - n)
            gain = (weights[f] if lead > 0 else 1.0) * (whole - (2 * n * p * (1 - p) + 2 * (len(y) - n) * q * (1 - q)) / len(y))
            k = int(np.argmax(gain > gain.max() - 1e-12))
            if gain[k] > best[0] + 1e-12:
                best = (gain[k], f, (v[at[k]] + v[at[k] + 1]) / 2)
        if best[1] is not None:
            _, self.feature, self.cut = best
            left = x[:, self.feature] <= self.cut
            self.low, self.high = (Tree(x[part], y[part], weights, lead - 1, depth - 1) for part in (left, ~left))

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature is None:
            return np.full(len(x), self.answer)
        out, left = np.empty(len(x), bool), x[:, self.feature] <= self.cut
        out[left], out[~left] = self.low.predict(x[left]), self.high.predict(x[~left])
        return out


def labelled_pages(pages: int = TABLE_PAGES, seed: int = TABLE_SEED) -> list[str]:
    """Pages whose words are + in the article and - elsewhere.

    Of every three pages one marks its article by an element, one by a name,
    and one not at all.  The first two hold everything that an article may lie
    beside or round; the third holds prose between blocks of links.
    """
    rng = random.Random(seed)
    pick = rng.choice
    size = lambda: pick((1, 2, 3, 4, 6, 9, 11, 14, 20, 30, 45, 60, 90, 120))
    text = lambda sign, n: " ".join([sign] * n)
    link = lambda sign, n: f"<a>{text(sign, n)}</a>"

    def links(sign: str) -> str:
        kind, items = pick(("ul", "div", "row")), [link(sign, rng.randint(1, 5)) for _ in range(rng.randint(2, 8))]
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return "".join(f"<div>{i}</div>" for i in items) if kind == "div" else f"<div>{' '.join(items)}</div>"

    def aside(marks: tuple[str, ...]) -> str:
        inside = "".join(pick((f"<p>{text('-', size())}</p>", f"<h3>{text('-', rng.randint(1, 4))}</h3><p>{text('-', size())}</p>", links("-"), text("-", size()))) for _ in range(rng.randint(1, 3)))
        opened = pick(marks)
        if opened != "form" and rng.random() < 0.15:
            inside = f"<article>{inside}</article>"
        return f"<{opened}>{inside}</{opened.split()[0]}>"

    def prose(marks: tuple[str, ...]) -> str:
        out = [f"<h1>{text('+', rng.randint(1, 12))}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.6:
                out.append(f"<p>{text('+', size())}</p>")
            elif kind < 0.7:
                out.append(f"<p>{text('+', size())} {link('+', rng.randint(1, 6))} {text('+', rng.randint(0, 8))}</p>")
            elif kind < 0.78:
                out.append(f"<h2>{text('+', rng.randint(1, 8))}</h2>")
            elif kind < 0.86:
                out.append(pick((links("+"), f"<p>{link('+', rng.randint(1, 6))}</p>")))
            elif kind < 0.92:
                out.append("<ul>" + "".join(f"<li>{text('+', rng.randint(1, 15))}</li>" for _ in range(rng.randint(1, 4))) + "</ul>")
            elif marks:
                out.append(aside(marks))
        return "".join(out)

    elements = ("aside", "footer", "nav", "form", "div role=complementary", "div role=navigation", "div hidden")
    names = ("div class=sidebar", "div class=ad", "div id=comments", "div class='cookie notice'", "section class=newsletter", "div class=related-posts", "div id=footer", "div class=menu", "div class='post-comments'", "div class='social share'")
    out = []
    for k in range(pages):
        marks = elements + names
        if k % 15 == 2:  # nothing but prose
            out.append("".join(f"<p>{text('+', size())}</p>" for _ in range(rng.randint(1, 3))))
            continue
        if k % 3 == 2:
            long = "".join(pick((f"<p>{text('+', rng.randint(20, 130))}</p>", f"<div>{text('+', rng.randint(25, 130))}</div>", f"<p>{text('+', rng.randint(18, 60))} {link('+', rng.randint(1, 4))}</p>")) + (f"<p>{text('+', rng.randint(2, 12))}</p>" if rng.random() < 0.2 else "") for _ in range(rng.randint(2, 6)))
            head = f"<h1>{text('+', rng.randint(2, 12))}</h1>" if rng.random() < 0.6 else ""
            foot = "".join(f"<div>{text('-', rng.randint(1, 6))}</div>" if rng.random() < 0.4 else links("-") for _ in range(rng.randint(0, 2)))
            out.append(links("-") + (f"<div>{text('-', rng.randint(1, 5))}</div>" + links("-") if rng.random() < 0.3 else "") + head + long + f"<p>{text('+', rng.randint(16, 80))}</p>" + (links("-") if foot else "") + foot)
            continue
        before = "".join(aside(marks) for _ in range(rng.randint(0, 3))) + (f"<header>{pick(('', links('-')))}<p>{text('-', size())}</p></header>" if rng.random() < 0.5 else "")
        after = "".join(aside(marks) for _ in range(rng.randint(0, 3)))
        if k % 3 == 0:
            tag = pick(("article", "main", "div role=main"))
        else:
            tag = pick(("div class=content", "div id=main", "section class=post", "div class='entry wide'", "td class=story", "div class='page-content'"))
        whole = f"<{tag}>{prose(marks)}</{tag.split()[0]}>"
        out.append(before + (f"<form>{whole}</form>" if rng.random() < 0.05 else whole) + after)
    return out


def labelled_table(pages: int = TABLE_PAGES, seed: int = TABLE_SEED) -> tuple[np.ndarray, np.ndarray]:
    rows, labels = [], []
    for page in labelled_pages(pages, seed):
        found = blocks(page)
        rows.append(features(found))
        labels += [b[0].startswith("+") for b in found]
    return np.vstack(rows), np.array(labels)


@lru_cache(maxsize=1)
def trained() -> Tree:
    return Tree(*labelled_table())


def extract(html: str, tree: Tree | None = None) -> str:
    """The article's blocks in page order, joined by line breaks; empty without any."""
    found = blocks(html)
    if not found:
        return ""
    x = features(found)
    # Where nothing is linked, enclosed or named, nothing tells one block from another: all of it is the text.
    keep = (tree or trained()).predict(x) if x[:, 1].any() or x[:, 6:11].any() else np.ones(len(x), bool)
    return "\n".join(b[0] for b, k in zip(found, keep) if k)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of (page_id, url, html), whole pages.

    Null or empty html gives an empty text.  Rows stay as they are: null ids,
    null urls and repeated rows too.
    """

    tree = trained()  # grown once, on the driver

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [extract(h or "", tree) for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"].array, "url": batch["url"], "text": texts, "n_chars": list(map(len, texts))})

    kind = pages.schema["page_id"].dataType.simpleString()
    return small_batches(pages.select("page_id", "url", "html")).mapInPandas(run, f"page_id {kind}, url string, text string, n_chars bigint")
