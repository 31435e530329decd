"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded over the tree.

Every element gets features of itself, its subtree (text, link and tag density), its
attribute tokens and those of its ancestors, its depth and its siblings. Boosted trees
give the probability that its own text belongs to the article. Decoding chooses one of
three states for every element so that the whole tree is likeliest: in the article,
out of it, or a wrapper (its own text is out, elements in it may be in). Below an element
that is out everything is out, and below one that is in nothing is a wrapper, so no two
choices of ancestor and descendant contradict each other.

The model is trained on ``PAGES`` generated pages with known roles, from a fixed seed; it
depends on no table. Null or empty html, or a page without article text, gives empty
text, an empty table no rows; other columns are not read. Repeated rows are extracted each.
Texts are whole: nothing is dropped for length, and time grows in proportion to the markup,
however long or deep.
"""

from __future__ import annotations

import random
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from heddle.llm.boosting import Boosted
from heddle.llm.dom import BLOCK, RAW, Tree, marks

PAGES, SEED = 700, 20
BREAK = '<br data-role="1">'

# fixed values: words of class, id and role that pages use
GOOD = ("article", "content", "post", "entry", "main", "body", "story", "text", "blog", "prose", "richtext", "page")
BAD = (
    "nav", "menu", "footer", "header", "sidebar", "advert", "sponsor", "promo", "banner", "cookie", "consent", "notice", "alert", "comment", "reply", "discuss", "share", "social",
    "related", "recommend", "breadcrumb", "form", "newsletter", "subscribe", "login", "signup", "popup", "modal", "widget", "toolbar", "pagination", "copyright", "legal", "search", "skip", "masthead", "teaser", "gdpr", "response", "complementary", "contentinfo", "aside", "author-box", "tags",
)
EXACT = frozenset(("ad", "ads", "adv", "ad-slot", "adbox", "ad-container"))
TAGS = {t: i for i, names in enumerate((("p", "blockquote", "pre"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("article", "main"), ("section", "div"), ("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "fieldset", "button", "select", "label", "input", "textarea", "option"), ("ul", "ol", "dl"), ("li", "dt", "dd"), ("table", "tbody", "thead", "tr", "td", "th"), ("a",), ("b", "i", "em", "strong", "span", "u", "code", "small", "sup", "sub", "mark"), ("figure", "figcaption", "img"), tuple(RAW), ("body", "html", "head", "#root")), 1) for t in names}
NAMED = ("article", "main", "nav", "header", "footer", "aside", "form", "li", "table")


@lru_cache(maxsize=50_000)
def attribute_votes(attributes: str) -> tuple[int, int]:
    words = marks(attributes)
    if not words:
        return 0, 0
    return sum(w in words for w in GOOD), sum(w in words for w in BAD) + sum(w in EXACT for w in words.split())


def node_features(tree: Tree) -> np.ndarray:
    """One row per element, in page order."""
    n = len(tree.tag)
    parent = tree.parent
    own, starts, seen = [0] * n, [0] * n, 0
    commas = [0] * n
    for node, text in tree.runs:
        if text and tree.tag[node] not in RAW:
            size = len(text) - text.count(" ")
            own[node] += size
            commas[node] += text.count(",") + text.count(".")
            seen += size
    whole, links, tags, stops = own[:], [0] * n, [1] * n, commas[:]
    children, blocks = [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        p = parent[i]
        if tree.tag[i] == "a":
            links[i] = whole[i]
        whole[p] += whole[i]
        links[p] += links[i]
        tags[p] += tags[i]
        stops[p] += stops[i]
        children[p] += 1
        blocks[p] += tree.tag[i] in BLOCK
    del starts
    depth, good, bad = [0] * n, [0] * n, [0] * n
    above_good, above_bad, within = [0] * n, [0] * n, [0] * n
    place, same, seen_tags = [0] * n, [0] * n, {}
    before, passed = [0] * n, [0] * n
    rows = np.empty((n, 30))
    for i in range(n):
        tag = tree.tag[i]
        good[i], bad[i] = attribute_votes(tree.attributes[i])
        p = parent[i]
        if p >= 0:
            depth[i] = depth[p] + 1
            above_good[i] = above_good[p] + good[p]
            above_bad[i] = above_bad[p] + bad[p]
            within[i] = within[p]
            place[i] = passed[p]
            passed[p] += 1
            key = (p, tag)
            same[i] = seen_tags[key] = seen_tags.get(key, -1) + 1
        if tag in NAMED:
            within[i] |= 1 << NAMED.index(tag)
    total = max(1, whole[0])
    running = 0
    for i in range(n):
        before[i] = running
        running += own[i]
    for i in range(n):
        p = max(parent[i], 0)
        size = whole[i]
        rows[i, :21] = (
            TAGS.get(tree.tag[i], 0), depth[i], children[i], own[i], size, links[i] / (size + 1), size / tags[i], stops[i] / (size + 1), good[i], bad[i], above_good[i], above_bad[i],
            place[i], children[p], same[i], TAGS.get(tree.tag[p], 0), size / total, before[i] / total, whole[p] / total, links[p] / (whole[p] + 1), blocks[i],
        )
        for k in range(len(NAMED)):
            rows[i, 21 + k] = within[i] >> k & 1
    return rows


def decode(tree: Tree, p: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """True for elements in the article: the likeliest consistent choice (in, out, wrapper)."""
    n = len(tree.tag)
    p = np.clip(p, 1e-4, 1 - 1e-4)
    gain_in, gain_out = (weights * np.log(p)).tolist(), (weights * np.log(1 - p)).tolist()
    best_in, best_out, best_wrap = gain_in[:], gain_out[:], gain_out[:]
    parent = tree.parent
    for i in range(n - 1, 0, -1):
        if tree.tag[i] in RAW:
            best_in[i] = best_wrap[i] = -1e18
        a = parent[i]
        best_out[a] += best_out[i]
        best_in[a] += max(best_in[i], best_out[i])
        best_wrap[a] += max(best_wrap[i], best_in[i], best_out[i])
    state = [0] * n  # 0 out, 1 in, 2 wrapper
    state[0] = 2
    for i in range(1, n):
        above = state[parent[i]]
        if above == 2:
            top = max(best_out[i], best_in[i], best_wrap[i])
            state[i] = 0 if top == best_out[i] else 1 if top == best_in[i] else 2
        elif above == 1:
            state[i] = 1 if best_in[i] > best_out[i] else 0
    return np.array(state) == 1


def blocks(tree: Tree, chosen: np.ndarray) -> list[str]:
    """The text of chosen elements by block, white space as one space, references decoded."""
    out, line = [], []
    for node, text in [*tree.runs, (0, None)]:
        if text is None:
            if line:
                if joined := " ".join(unescape("".join(line)).split()):
                    out.append(joined)
                line = []
        elif chosen[node] or (tree.tag[node] == "br" and chosen[tree.parent[node]]):
            line.append(text)
    return out


def sample_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page of a random layout, with the role of every element: data-role is 1 in the article."""
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuvéäñ") for _ in range(rng.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))

    def sentences(a, b):
        mark = rng.choice(["", "", "", "".join(rng.choice(["*", "!", "&amp;", "~", "#", "%", "=", "$", "|", "^"]) for _ in range(rng.randint(1, 4)))])
        return " ".join((words(3, 18) + rng.choice([".", ".", ",", ""]) + mark).capitalize() for _ in range(rng.randint(a, b)))

    def e(tag, inner="", role=0, **attributes):
        text = "".join(f' {k.rstrip("_")}="{v}"' for k, v in attributes.items())
        return f'<{tag} data-role="{role}"{text}>{inner}</{tag}>'

    def links(n, **a):
        items = "".join(e("li", e("a", words(1, 3), href="/" + word())) for _ in range(n))
        return e("ul", items, **a)

    pick = rng.choice
    maybe = lambda chance, make: make() if rng.random() < chance else ""
    noise = [
        lambda: e("nav", links(rng.randint(2, 9))), lambda: e("div", links(rng.randint(2, 9)), class_=pick(["menu", "main-nav", "navbar", "topmenu"])),
        lambda: e("div", pick([words(2, 14), sentences(1, 2), e("a", words(2, 5), href="#")]), class_=pick(["ad", "ads", "advert", "banner-ad", "promo", "sponsored", "ad-slot"])),
        lambda: e("aside", pick([links(4), e("h3", words(1, 3)) + e("p", sentences(1, 2)), words(3, 12)]), class_=pick(["sidebar", "", "related", "widget"])),
        lambda: e("div", pick([e("p", sentences(1, 2)), words(4, 15) + e("button", words(1, 2))]), class_=pick(["cookie-notice", "notice", "cookie-banner", "gdpr-consent", "alert", "subscribe-notice"])),
        lambda: e("form", e("label", words(1, 3)) + '<input data-role="0" type="text">' + e("button", words(1, 2)) + maybe(0.4, lambda: e("p", sentences(1, 1))), class_=pick(["newsletter", "search", "contact", ""])),
        lambda: e("script", "var a = '<p>" + words(3, 9) + "</p>';"), lambda: e("style", ".a{color:red}"), lambda: f"<!-- {words(1, 5)} -->",
        lambda: e("div", e("h4", words(1, 3)) + links(rng.randint(2, 6)), class_=pick(["related", "recommended", "more-stories"])),
        lambda: e("div", links(3), class_=pick(["share", "social-links", "breadcrumb", "pagination", "tags"])),
    ]

    def comments():
        each = lambda: pick([lambda: e("div", e("b", word()) + e("p", sentences(1, 3)), class_="comment"), lambda: e("li", e("p", sentences(1, 3))), lambda: e("p", sentences(1, 3))])()
        return e(pick(["section", "div", "ol", "aside"]), maybe(0.6, lambda: e("h3", words(1, 3))) + "".join(each() for _ in range(rng.randint(1, 5))), **{pick(["class_", "id"]): pick(["comments", "comment-list", "responses", "discussion", "reader-comments", "replies"])})

    def paragraph():
        kind = rng.random()
        if kind < 0.55:
            return e("p", sentences(1, 6), 1)
        if kind < 0.62:  # elements that are never closed
            inner = pick(["b", "i", "em", "strong", "span"])
            return f'<p data-role="1"><{inner} data-role="1">{sentences(1, 3)}{pick(["", BREAK])}'
        if kind < 0.65:
            return e("p", sentences(1, 2) + BREAK + sentences(1, 2), 1)
        if kind < 0.73:
            return e("p", f"{words(2, 8)} {e('a', words(1, 3), 1, href='#')} {sentences(1, 2)} {e('em', words(1, 2), 1)}", 1)
        if kind < 0.80:
            return e(pick(["h2", "h3"]), words(1, 6), 1)
        if kind < 0.86:
            return e(pick(["ul", "ol"]), "".join(e("li", sentences(1, 1), 1) for _ in range(rng.randint(2, 5))), 1)
        if kind < 0.90:
            return e("blockquote", pick([e("p", sentences(1, 2), 1), sentences(1, 2)]), 1)
        if kind < 0.94:
            return e("table", "".join(e("tr", "".join(e("td", words(1, 3), 1) for _ in range(3)), 1) for _ in range(rng.randint(1, 4))), 1)
        if kind < 0.955:
            return e("pre", words(3, 12), 1)
        if kind < 0.97:
            return e("figure", '<img data-role="1" src="a.png">' + e("figcaption", words(2, 9) + ".", 1), 1)
        return e("p", pick([word().capitalize() + ".", words(1, 3)]), 1)

    body = [paragraph() for _ in range(rng.randint(1, 14))]
    for k in range(len(body) - 1, 0, -1):
        if rng.random() < 0.08:
            body.insert(k, pick(noise)())
    title = words(2, 12).capitalize()
    head = maybe(0.8, lambda: e("h1", title, 1))
    if rng.random() < 0.2:
        head = e("header", head + maybe(0.4, lambda: e("p", sentences(1, 1), 1)), 1)
    inner = head + "".join(body) + maybe(0.12, comments) + maybe(0.1, pick(noise))
    shape = rng.random()
    if shape < 0.45:
        article = e("article", inner, 1, **pick([{}, {}, {"class_": "post"}, {"id": "story"}]))
    elif shape < 0.6:
        article = e("main", inner, 1)
    elif shape < 0.75:
        article = e("main", e("article", inner, 1) + maybe(0.4, comments), 0)
    elif shape < 0.9:
        article = e("div", inner, 1, **{pick(["class_", "id"]): pick(["content", "post-content", "entry", "article-body", "main-content", "story-text", "post"])})
    else:
        article = e(pick(["div", "section"]), inner, 1)
    top = maybe(0.5, lambda: e("header", pick([e("a", words(1, 3)), e("h1", words(1, 4)), ""]) + maybe(0.5, lambda: e("nav", links(rng.randint(2, 7))))))
    sign = pick(["&copy;", "&reg;", "&middot;", "&bull;", "&raquo;", "|", "-"])
    small = pick([f"{sign} {words(1, 5)}", links(3), e("p", f"{sign} {sentences(1, 1)}"), f"{words(1, 4)} {sign} {sentences(1, 2)}", e("small", words(1, 5))])
    end = maybe(0.8, lambda: e("footer", small) if rng.random() < 0.7 else e("div", small, **{pick(["class_", "id"]): pick(["footer", "site-footer", "bottom", "copyright", "legal"])}))
    middle = "".join(pick(noise)() for _ in range(rng.randint(0, 3))) + article + maybe(0.25, comments) + "".join(pick(noise)() for _ in range(rng.randint(0, 2)))
    if rng.random() < 0.3:
        middle = e("div", middle, 0, **pick([{}, {"class_": "container"}, {"id": "wrapper"}]))
    if rng.random() < 0.08:  # cells of a table of the whole page
        side = e("td", links(rng.randint(2, 6)), **pick([{}, {"class_": "menu"}, {"width": "150"}]))
        middle = e("table", e("tr", e("td", words(1, 4) + e("a", words(1, 2)), colspan="2")) + e("tr", side + e("td", e("div", inner, 1), 0)) + e("tr", e("td", small, colspan="2")))
        top = end = ""
    page = f'<!DOCTYPE html><html data-role="0"><head data-role="0"><meta data-role="0" charset="utf-8"><title data-role="0">{title}</title></head><body data-role="0">' + top + middle + end
    return page + maybe(0.9, lambda: "</body></html>")


@lru_cache(maxsize=1)
def model() -> Boosted:
    rng = random.Random(SEED)
    x, y = [], []
    for _ in range(PAGES):
        tree = Tree(sample_page(rng))
        roles = [a.startswith(' data-role="1"') for a in tree.attributes]
        tree.attributes = [a[14:] for a in tree.attributes]
        x.append(node_features(tree))
        y.append(np.array(roles, float))
    attribute_votes.cache_clear()
    return Boosted().fit(np.concatenate(x), np.concatenate(y))


def main_texts(pages: list[str | None], trained: Boosted) -> list[str]:
    out: list[str] = []
    for start in range(0, len(pages), 200):
        trees = [Tree(html) if html else None for html in pages[start : start + 200]]
        features = [node_features(t) for t in trees if t is not None]
        p = trained.predict(np.concatenate(features)) if features else np.zeros(0)
        at = 0
        for tree in trees:
            if tree is None:
                out.append("")
                continue
            own = np.zeros(len(tree.tag))
            for node, text in tree.runs:
                if text and not text.isspace():
                    own[node] += len(text)
            chosen = decode(tree, p[at : at + len(tree.tag)], 1 + np.sqrt(own))
            at += len(tree.tag)
            out.append("\n".join(blocks(tree, chosen)))
    return out


def main_text(html: Column) -> Column:
    trained = model()  # trained once on the driver, a few kB in the closure

    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pd.Series(main_texts(pages.tolist(), trained), dtype=object)

    return extract(html)
