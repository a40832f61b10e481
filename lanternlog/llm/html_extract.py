"""Main text of web pages: boosted trees judge the blocks of a page, and a decoding over its tree makes the choices agree.

A page becomes a tree of block elements; inline elements only add text to the block around them. Each node has features of its
own text, of its subtree, of its attributes and those around it, of its depth and its siblings. A node can be kept only inside kept
nodes: for each node the better of two values is taken, that of keeping it with the best choice for every child, and that of
dropping all of it.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternlog.llm.common import map_batches, slices, texts_of

#: Pages to learn from, their largest length, layouts made of each, and the shape of the model.
SAMPLE, SAMPLE_CHARS, LAYOUTS, TREES, DEPTH, BINS, RATE = 300, 50_000, 4, 50, 4, 32, 0.3

# Elements of the markup language.
BLOCKS = frozenset(
    "html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th section article main aside nav "
    "header footer form fieldset legend blockquote pre figure figcaption address details summary center menu dialog hgroup hr".split()
)
SKIPPED = frozenset("script style noscript template textarea title select svg math iframe object audio video canvas button head".split())
RAW = frozenset("script style textarea title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that an element of this kind ends, and the elements beyond which it does not look.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "thead": ({"thead", "tbody"}, {"table"}),
    "tbody": ({"thead", "tbody"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}),
}
#: Parts of class, id and role values, by what they say about a block.
TOKENS = {
    "main": "article content post entry story main body text prose articlebody",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs toolbar sitemap skip",
    "advert": "ad ads adv advert advertisement adsense banner sponsor sponsored promo promotion promoted outbrain taboola",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup paywall disclaimer",
    "comment": "comment comments commentlist disqus reply replies respond discussion reader",
    "side": "sidebar side aside complementary rail widget related recommended recommendations trending popular share sharing social "
    "follow tags meta footer foot contentinfo copyright header masthead branding logo search login form contact",
}
KIND_OF = {token: i for i, words in enumerate(TOKENS.values()) for token in words.split()}
KINDS = len(TOKENS)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+[^>]*+)>?", re.S
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden|style|data-main)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Page:
    """Block elements in page order, and the texts between their borders with the node each belongs to."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)  # one past the last node of the subtree
    marks: list[int] = field(default_factory=list)  # bits: kinds of attribute tokens, then hidden, then known main text
    inner: list[int] = field(default_factory=list)  # inline elements in the block
    texts: list[tuple[int, str, int]] = field(default_factory=list)  # node, text, characters in links


def _marks(attributes: str) -> int:
    out = 0
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role", "itemprop"):
            for word in WORD.findall(value):
                kind = KIND_OF.get(word.lower())
                if kind is not None:
                    out |= 1 << kind
        elif name == "data-main":
            out |= 1 << (KINDS + 1)
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and HIDDEN.search(value)):
            out |= 1 << KINDS
    return out


def parse(source: str) -> Page:
    """The blocks of a page. Missing end tags are supplied, surplus ones ignored; scripts, styles and controls are left out."""
    page = Page()
    open_ = [0]
    page.tags.append("html")
    page.parents.append(-1)
    page.ends.append(0)
    page.marks.append(0)
    page.inner.append(0)
    held: list[str] = []
    linked, link = 0, False

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                page.texts.append((open_[-1], text, min(linked, len(text))))
            held.clear()
            linked = 0

    def close(depth: int) -> None:
        while len(open_) > depth:
            page.ends[open_.pop()] = len(page.tags)

    at, size = 0, len(source)
    while at < size:
        start = source.find("<", at)
        if start < 0:
            start = size
        if start > at:
            text = entities.unescape(source[at:start])
            held.append(text)
            if link:
                linked += len(text)
        if start == size:
            break
        found = TOKEN.match(source, start)
        if not found:
            held.append("<")
            at = start + 1
            continue
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag, attributes = tag.lower(), found[3]
        if found[1]:
            if tag == "a":
                link = False
            elif tag in BLOCKS and tag not in ("html", "body", "hr"):
                for depth in range(len(open_) - 1, 0, -1):
                    if page.tags[open_[depth]] == tag:
                        flush()
                        close(depth)
                        break
            continue
        if tag in SKIPPED and not attributes.endswith("/"):
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(source, at)
            if stop:
                at = stop.end()
            elif tag in RAW:
                at = size
            if tag not in RAW:
                held.append(" ")
            continue
        if tag == "a":
            link = True
        if tag not in BLOCKS:
            if tag in ("br", "img", "input"):
                held.append(" ")
            page.inner[open_[-1]] += 1
            continue
        flush()
        if tag in ("html", "body"):
            page.marks[0] |= _marks(attributes) & ~(1 << (KINDS + 1)) if attributes else 0
            continue
        if page.tags[open_[-1]] == "p" or (tag in HEADINGS and page.tags[open_[-1]] in HEADINGS):
            close(len(open_) - 1)
        if tag in ENDS:
            ended, beyond = ENDS[tag]
            for depth in range(len(open_) - 1, 0, -1):
                name = page.tags[open_[depth]]
                if name in beyond:
                    break
                if name in ended:
                    close(depth)
                    break
        if tag == "hr":
            continue
        page.parents.append(open_[-1])
        open_.append(len(page.tags))
        page.tags.append(tag)
        page.ends.append(0)
        page.marks.append(_marks(attributes) if attributes else 0)
        page.inner.append(0)
    flush()
    close(0)
    return page


GROUPS = (
    frozenset(("p", "blockquote", "pre")), HEADINGS, frozenset(("li", "dt", "dd")), frozenset(("td", "th", "caption")),
    frozenset(("div", "section")), frozenset(("article", "main")), frozenset(("nav", "aside", "footer", "menu")),
    frozenset(("header",)), frozenset(("form", "fieldset", "dialog")),
)
PUNCTUATION = re.compile(r"[.!?](?:\s|$)")


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all nodes of all pages: features, parents, own characters, and whether they are known to be main text."""
    sizes = np.array([len(p.tags) for p in pages], np.int64)
    base = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    shift = np.repeat(base, sizes)
    parents = np.concatenate([np.array(p.parents, np.int64) for p in pages])
    root = parents < 0
    parents = np.where(root, -1, parents + shift)
    ends = np.concatenate([np.array(p.ends, np.int64) for p in pages]) + shift
    marks = np.concatenate([np.array(p.marks, np.int64) for p in pages])
    inner = np.concatenate([np.array(p.inner, np.float64) for p in pages])
    own = np.zeros((n, 5))  # characters, in links, words, sentence ends, commas
    for page, start in zip(pages, base.tolist(), strict=True):
        for node, text, linked in page.texts:
            own[start + node] += (len(text), linked, text.count(" ") + 1, len(PUNCTUATION.findall(text)), text.count(","))
    groups = np.zeros(n, np.int64)
    kinds: dict[str, int] = {}
    codes = []
    for page in pages:
        for tag in page.tags:
            code = kinds.get(tag)
            if code is None:
                code = kinds[tag] = sum(1 << i for i, group in enumerate(GROUPS) if tag in group)
            codes.append(code)
    groups[:] = codes
    # What holds for an ancestor, level by level.
    depth = np.zeros(n, np.int64)
    level, around, within = np.flatnonzero(root), marks.copy(), groups.copy()
    kids_of = np.argsort(parents, kind="stable")
    kids_of = kids_of[parents[kids_of] >= 0]
    begin, stop = np.searchsorted(parents[kids_of], np.arange(n)), np.searchsorted(parents[kids_of], np.arange(n), side="right")
    while len(level):
        counts = stop[level] - begin[level]
        total = int(counts.sum())
        places = np.repeat(begin[level] - (np.cumsum(counts) - counts), counts) + np.arange(total)
        level = kids_of[places]
        depth[level] = depth[parents[level]] + 1
        around[level] |= around[parents[level]]
        within[level] |= within[parents[level]]
    sums = np.concatenate([np.zeros((1, 6)), np.cumsum(np.column_stack([own, inner + 1]), axis=0)])
    subtree = sums[ends] - sums[np.arange(n)]
    page_sum = np.repeat(subtree[base], sizes, axis=0)
    before = (sums[np.arange(n), 0] - np.repeat(sums[base, 0], sizes)) / np.maximum(page_sum[:, 0], 1)
    up = np.maximum(parents, 0)
    brothers = np.bincount(up[~root], minlength=n)[up]
    brothers[root] = 1
    sibling_sum = np.zeros(n)
    np.add.at(sibling_sum, up[~root], subtree[~root, 0])
    mean_sibling = sibling_sum[up] / np.maximum(brothers, 1)
    order = np.empty(n)
    order[kids_of] = np.arange(len(kids_of)) - begin[parents[kids_of]]
    order[root] = 0
    bit = lambda values, i: (values >> i & 1).astype(float)
    columns = [
        np.minimum(depth, 20), np.log1p(own[:, 0]), own[:, 1] / np.maximum(own[:, 0], 1), own[:, 0] / np.maximum(own[:, 2], 1),
        own[:, 3] / np.maximum(own[:, 2], 1), own[:, 4] / np.maximum(own[:, 2], 1), np.log1p(subtree[:, 0]),
        subtree[:, 1] / np.maximum(subtree[:, 0], 1), subtree[:, 0] / np.maximum(page_sum[:, 0], 1), subtree[:, 0] / subtree[:, 5],
        np.log1p(brothers), order / np.maximum(brothers, 1), np.log1p(mean_sibling), subtree[:, 0] / np.maximum(sibling_sum[up], 1),
        before, *(bit(groups, i) for i in range(len(GROUPS))), *(bit(within, i) for i in range(5, len(GROUPS))),
        *(bit(marks, i) for i in range(KINDS + 1)), *(bit(around, i) for i in range(KINDS + 1)),
    ]
    return np.column_stack(columns), parents, own[:, 0], bit(around, KINDS + 1) > 0


@dataclass
class Trees:
    """Boosted trees of equal depth, each as arrays in heap order: feature, threshold, and the value of each leaf."""

    base: float
    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out = np.full(len(rows), self.base)
        every = np.arange(len(rows))
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            at = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (rows[every, feature[at]] > threshold[at])
            out += leaf[at - len(feature)]
        return out

    @classmethod
    def fit(cls, rows: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> Trees:
        """Gradient boosting of the logistic loss on binned features."""
        n, wide = rows.shape
        edges = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(wide)]
        edges = [e if len(e) else np.zeros(1) for e in edges]
        binned = np.column_stack([np.searchsorted(e, rows[:, j], side="left") for j, e in enumerate(edges)])
        share = float(np.average(truth, weights=weight))
        base = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        score, inner = np.full(n, base), (1 << DEPTH) - 1
        made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            slope, curve = weight * (truth - p), weight * p * (1 - p) + 1e-9
            feature, threshold, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
            for level in range(DEPTH):
                first, nodes = (1 << level) - 1, 1 << level
                local = at - first
                best = np.zeros(nodes)
                for j in range(wide):
                    key = local * BINS + binned[:, j]
                    g = np.bincount(key, slope, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1)
                    h = np.bincount(key, curve, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1)
                    all_g, all_h = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + 1) + (all_g - g) ** 2 / (all_h - h + 1) - all_g**2 / (all_h + 1)
                    gain[(h < 1) | (all_h - h < 1)] = 0
                    cut = gain[:, : len(edges[j])].argmax(axis=1)
                    value = gain[np.arange(nodes), cut]
                    better = value > best + 1e-9
                    best[better] = value[better]
                    feature[first : first + nodes][better] = j
                    threshold[first : first + nodes][better] = edges[j][cut[better]]
                at = 2 * at + 1 + (rows[np.arange(n), feature[at]] > threshold[at])
            leaf = at - inner
            values = RATE * np.bincount(leaf, slope, 1 << DEPTH) / (np.bincount(leaf, curve, 1 << DEPTH) + 1)
            score += values[leaf]
            made.append((feature, threshold, values))
        return cls(base, *(np.array([m[i] for m in made]) for i in range(3)))


def decode(parents: np.ndarray, weight: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Which nodes to keep: the best sum of weighted log odds where nothing is kept inside a dropped node.

    Nodes stand in page order, so a parent comes before its children. Roots may stay without text of their own.
    """
    own = weight * odds
    kept_value, dropped_value = own.copy(), -own
    depth = np.zeros(len(parents), np.int64)
    levels = [np.flatnonzero(parents < 0)]
    order = np.argsort(parents, kind="stable")
    order = order[parents[order] >= 0]
    sorted_parents = parents[order]
    while len(levels[-1]):
        a, b = np.searchsorted(sorted_parents, levels[-1]), np.searchsorted(sorted_parents, levels[-1], side="right")
        counts = b - a
        places = np.repeat(a - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        levels.append(order[places])
        depth[levels[-1]] = len(levels) - 1
    for level in reversed(levels[1:]):
        np.add.at(kept_value, parents[level], np.maximum(kept_value[level], dropped_value[level]))
        np.add.at(dropped_value, parents[level], dropped_value[level])
    keep = kept_value > dropped_value
    for level in levels[1:]:
        keep[level] &= keep[parents[level]]
    return keep


def _layout(rng: random.Random, main: list[str], other: list[str], links: list[str]) -> str:
    """A page of known main text: blocks of real pages put into markup as sites use it."""

    def some(low: int, high: int) -> list[str]:
        return [entities.escape(rng.choice(other)) for _ in range(rng.randint(low, high))]

    def anchors(low: int, high: int) -> str:
        return "".join(f'<li><a href="#">{entities.escape(rng.choice(links))}</a></li>' for _ in range(rng.randint(low, high)))

    def box(tag: str, names: str, body: str) -> str:
        name = rng.choice(names.split() + [""] * (tag != "div"))
        return f'<{tag} {rng.choice(("class", "id"))}="{name}">{body}</{tag}>' if name else f"<{tag}>{body}</{tag}>"

    def paragraphs(low: int, high: int) -> str:
        return "".join(f"<p>{t}</p>" for t in some(low, high))

    menu = f"<ul>{anchors(3, 9)}</ul>"
    comments = "".join(
        rng.choice(('<li class="comment"><b>{n}</b><p>{t}</p></li>', '<div class="comment-body"><p>{t}</p></div>', "<li>{n}<p>{t}</p></li>",
                    '<article class="comment"><p>{t}</p></article>')).format(n=rng.choice(links), t=t) for t in some(1, 6)
    )
    extras = {
        "nav": rng.choice((box("nav", "menu main-nav navbar", menu), box("div", "menu navigation nav-main topnav breadcrumbs", menu), f"<nav>{anchors(3, 6)}</nav>")),
        "header": box("header", "site-header masthead header", rng.choice((f"<h2>{rng.choice(links)}</h2>", f"<p>{rng.choice(other)}</p>", menu))),
        "top": box("div", "header masthead branding logo", f"<p>{rng.choice(other)}</p>"),
        "advert": box("div", "ad ads advert ad-slot sponsored promo banner advertisement", rng.choice(("", "<p>")) + rng.choice(other)),
        "notice": box("div", "cookie-notice cookie-banner consent newsletter-signup alert notice gdpr popup", paragraphs(1, 2)),
        "aside": box("aside", "sidebar related widget-area", rng.choice((paragraphs(1, 3), menu, f"<h3>{rng.choice(links)}</h3>{paragraphs(1, 2)}"))),
        "side": box("div", "sidebar sidebar-content right-rail widget related-posts recommended social-share", rng.choice((paragraphs(1, 3), menu))),
        "form": box("form", "contact-form search-form login subscribe", f"<label>{rng.choice(links)}</label><input><p>{rng.choice(other)}</p><button>{rng.choice(links)}</button>"),
        "comments": rng.choice((box("section", "comments comment-list discussion", f"<h2>{rng.choice(links)}</h2><ol>{comments}</ol>"),
                                box("div", "comments comment-content disqus replies reader-comments", comments))),
        "footer": rng.choice((box("footer", "site-footer footer", f"&copy; {rng.choice(other)}"), box("div", "footer footer-content site-footer copyright", paragraphs(1, 2)),
                              f"<footer><p>{rng.choice(other)}</p>{menu}</footer>")),
    }
    title, body = main[0], main[1:]
    head = f"<h1>{entities.escape(title)}</h1>"
    if rng.random() < 0.2:
        head = f"<header>{head}</header>"
    parts = []
    for text in body:
        text = entities.escape(text)
        cut = len(text) // 3
        parts.append(rng.choice((f"<p>{text}</p>",) * 8 + (
            f"<p>{text}", f"<div>{text}</div>", f"<blockquote><p>{text}</p></blockquote>", f"<ul><li>{text}</li></ul>", f"<p><b>{text}<br>",
            f'<p>{text[:cut]}<a href="#">{text[cut:cut + 12]}</a>{text[cut + 12:]}</p>', f"<h2>{text[:60]}</h2><p>{text[60:]}</p>",
            f"<table><tr><td>{text}</td></tr></table>",
        )))
    inside = []  # boilerplate between the paragraphs
    if parts and rng.random() < 0.35:
        inside.append((rng.randint(1, len(parts)), extras[rng.choice(("advert", "notice", "aside", "side", "form", "comments"))]))
    text = ""
    for i, part in enumerate(parts):
        text += "".join(f"</div>{x}<div data-main>" for at, x in inside if at == i) + part
    text = f"<div data-main>{head}{text}</div>" + "".join(x for at, x in inside if at == len(parts))
    names = ("content", "post", "entry-content", "article-body", "story", "main", "post-content", "text", "page")
    shell = rng.choice((
        "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<article class="post">{}</article>',
        f'<div class="{rng.choice(names)}">{{}}</div>', f'<div id="{rng.choice(names)}"><div>{{}}</div></div>', "<div>{}</div>",
        "<section>{}</section>", "{}",
    ))
    chosen = [k for k in extras if rng.random() < 0.45]
    early = [k for k in chosen if k in ("nav", "header", "top") or (k in ("advert", "notice", "side", "aside", "form") and rng.random() < 0.5)]
    late = [k for k in chosen if k not in early]
    out = "".join(extras[k] for k in early) + shell.format(text) + "".join(extras[k] for k in late)
    return f"<body>{box('div', 'wrapper container page site', out) if rng.random() < 0.4 else out}</body>"


def fit(sources: list[str]) -> Trees | None:
    """The model, from pages whose markup names their main text, as they are and with their blocks in other layouts."""
    rng = random.Random(20240131)
    blocks, other, links, known = [], [], [], []
    for source in sources:
        page = parse(source)
        node_in = np.array([tag in ("article", "main") for tag in page.tags])
        out_of = np.array([tag in ("nav", "aside", "footer", "form") for tag in page.tags]) | np.array([m >> KINDS & 1 for m in page.marks], bool)
        for i, parent in enumerate(page.parents):
            if parent >= 0:
                node_in[i] |= node_in[parent]
                out_of[i] |= out_of[parent]
        truth = node_in & ~out_of
        if not truth.any():
            continue
        known.append((page, truth))
        main = [t for node, t, _ in page.texts if truth[node]]
        if main:
            blocks.append(main)
        other += [t for node, t, linked in page.texts if not truth[node] and linked < len(t) / 2]
        links += [t for node, t, linked in page.texts if not truth[node] and linked >= len(t) / 2]
    if not blocks:
        return None
    # Prose stands outside the main text too, so some of it is drawn from other pages.
    other += [rng.choice(rng.choice(blocks))[: rng.randint(20, 400)] for _ in range(max(len(other), 100))]
    links = links or [t[:20] for t in other]
    made = [parse(_layout(rng, main[: rng.randint(2, max(2, len(main)))], other, links)) for main in blocks for _ in range(LAYOUTS)]
    rows, _, chars, truth = features(made + [p for p, _ in known])
    truth[len(truth) - sum(len(t) for _, t in known) :] = np.concatenate([t for _, t in known])
    mine = chars > 0  # only blocks with text of their own are judged
    return Trees.fit(rows[mine], truth[mine].astype(float), np.log1p(chars[mine]))


def extract(pages: list[Page], model: Trees | None) -> list[str]:
    """Main text of each page: its kept blocks in page order, one a line."""
    if model is None or not pages:
        return ["" for _ in pages]
    rows, parents, chars, _ = features(pages)
    odds = np.zeros(len(rows))
    mine = chars > 0
    odds[mine] = model.score(rows[mine])
    keep = decode(parents, chars, odds).tolist()
    out, base = [], 0
    for page in pages:
        out.append("\n".join(text for node, text, _ in page.texts if keep[base + node]))
        base += len(page.tags)
    return out


def learn(df: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> Trees | None:
    """A model from about ``sample`` pages of at most SAMPLE_CHARS characters that mark their main text, picked by a hash."""
    marked = df.select(F.col(html_col).alias("_html"), F.xxhash64(F.col(id_col).cast("string")).alias("_hash")).filter(
        (F.length("_html") <= SAMPLE_CHARS) & F.lower("_html").rlike("<(article|main)[ >]")
    )
    n, scale = marked.count(), 1 << 30
    if n > sample:
        marked = marked.filter(F.pmod("_hash", F.lit(scale)) < int(scale * sample / n))
    return fit(sorted(r["_html"] for r in marked.select("_html").collect()))


def main_text(df: DataFrame, model: Trees | None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every whole page, one row per input row.

    Null and empty pages, and pages without main text, have an empty text; so have all pages without a model. Character
    references are decoded, white space in a block becomes one space, and blocks are joined by one line feed. Ids may
    be null or repeated; further columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            texts = extract([parse(x) for x in texts_of(batch, 2)], model)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [id_col, url_col, "text", "n_chars"],
            )

    kinds = [df.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    schema = f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars bigint"
    return map_batches(df.select(id_col, url_col, html_col), work, schema)
