"""The main text of web pages, by a tree-structured model over their elements.

A page becomes a tree of elements with its runs of text as leaves. Every node is either
main text or not. What a node looks like (its tag, the words in its class and id, how much
text and how many links it holds) speaks for one of them, and a table for each kind of
element says how likely it goes with its parent. Messages passed from the leaves up and
from the root down sum over all ways to mark the rest of the page and give each leaf's
probability of being main text; leaves of one half or more are kept.

The weights are fitted, by the gradient of the exact likelihood (expectations come from the
same messages), on labelled pages: those given with their texts, or else a bounded sample
of pages whose own markup names the article, and made-over pages in other layouts, with
those pages' paragraphs in them, for whatever names their parts otherwise.
"""

from __future__ import annotations

import html as entities
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, whole_text

#: Pages that are learned from at most, the characters of one at most, made-over pages for each, rounds of fitting.
MAX_PAGES, MAX_CHARS, LAYOUTS, ROUNDS = 120, 40_000, 3, 250
DECAY = 0.0005
THRESHOLD = 0.5

# fixed values: what elements are, and the words that classes and ids are read for
RAW = "script style title textarea xmp iframe noembed noframes".split()
DROPPED = "noscript template svg select button datalist object audio video canvas".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
INLINE = "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var".split()
TAGS = "html body div p article main section nav header footer aside form fieldset ul ol li dl dt dd table tbody thead tr td th h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address details summary dialog menu hgroup span a ins label center".split()
KINDS = {
    "heading": "h1 h2 h3 h4 h5 h6 hgroup", "paragraph": "p pre blockquote dd dt", "list": "ul ol dl li menu", "article": "article", "main": "main", "section": "section", "apart": "nav header footer aside form fieldset dialog address",
    "table": "table tbody thead tr td th", "inline": "span a ins label", "page": "html body",
}
NAMES = {
    "content": "article post entry story content main body text news blog",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs pagination pager tabs sitemap topnav submenu",
    "head": "header masthead banner logo topbar branding",
    "foot": "footer foot colophon copyright legal bottom",
    "side": "sidebar aside secondary widget widgets rail related recommended popular trending teaser teasers",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay dialog toast paywall warning",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion adsbygoogle",
    "comment": "comment comments commentlist reply replies respond disqus discussion reactions responses",
    "form": "form search newsletter subscribe subscription signup login contact register",
    "share": "share sharing shares social follow tweet facebook twitter",
}
#: What an open element of the key is closed by.
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "tbody": "tr td th tbody thead", "option": "option"}
#: Elements that such a closing doesn't reach out of.
FENCES = frozenset("ul ol dl table menu body".split())

_TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|$)""", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_RAW, _DROPPED, _VOID, _INLINE = map(frozenset, (RAW, DROPPED, VOID, INLINE))
_TAG_ID = {t: k for k, t in enumerate(TAGS)}
_GROUP = {w: k for k, words in enumerate(NAMES.values()) for w in words.split()}
_GROUPS = len(NAMES)
_CLOSES = {k: frozenset(v.split()) for k, v in CLOSES.items()}
#: Elements whose names speak against main text, or for it, are kinds of their own.
_KIND_NAMES = ["leaf", *KINDS, "named apart", "named content", "other"]
_APART = ((1 << len(NAMES)) - 1) & ~1
_KIND = {t: _KIND_NAMES.index(k) for k, words in KINDS.items() for t in words.split()}


def _groups(attributes: str) -> int:
    """A bit for each group of names that class, id and role speak of."""
    bits = 0
    for name, value in _NAMED.findall(attributes):
        for part in _PART.findall(value):
            part = part.lower()
            if part in _GROUP:
                bits |= 1 << _GROUP[part]
        if name.lower() == "itemprop" and "articleBody" in value:
            bits |= 1
    return bits


class Forest:
    """The trees of some pages. Parents stand before their children; node 0 of a page is its root."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.tag: list[int] = []  # -1: a leaf
        self.kind: list[int] = []
        self.groups: list[int] = []
        self.depth: list[int] = []
        self.page: list[int] = []
        # of the leaves
        self.leaf: list[int] = []
        self.block: list[int] = []
        self.text: list[str] = []
        self.linked: list[int] = []
        self.roots: list[int] = []

    def _node(self, parent: int, tag: str | None, groups: int) -> int:
        self.parent.append(parent)
        self.tag.append(-1 if tag is None else _TAG_ID.get(tag, len(TAGS)))
        other = len(_KIND_NAMES) - 1
        self.kind.append(0 if tag is None else other - 2 if groups & _APART else _KIND[tag] if tag in _KIND else other - 1 if groups else other)
        self.groups.append(groups)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.page.append(len(self.roots) - 1)
        return len(self.parent) - 1

    def add(self, page: str) -> None:
        self.roots.append(len(self.parent))
        root = self._node(-1, "html", 0)
        # (tag, node, whether what is in it is dropped)
        stack: list[tuple[str, int, bool]] = [("", root, False)]
        open_: dict[str, int] = {}
        links, at, block, fresh = 0, 0, 0, True
        pieces: list[str] = []
        linked = 0

        def flush() -> None:
            nonlocal pieces, linked
            if pieces:
                text = "".join(pieces)
                if not text.isspace():
                    self.leaf.append(self._node(stack[-1][1], None, 0))
                    self.block.append(block)
                    self.text.append(text)
                    self.linked.append(linked)
                elif self.leaf and self.page[self.leaf[-1]] == len(self.roots) - 1 and self.block[-1] == block:
                    self.text[-1] += " "
                pieces, linked = [], 0

        def pop() -> None:
            nonlocal links
            flush()
            tag = stack.pop()[0]
            open_[tag] -= 1
            if tag == "a":
                links -= 1

        while at < len(page):
            found = _TOKEN.search(page, at)
            stop = found.start() if found else len(page)
            if stop > at and not stack[-1][2]:
                raw = page[at:stop]
                piece = entities.unescape(raw) if "&" in raw else raw
                pieces.append(piece)
                if links:
                    linked += len(piece)
            if not found:
                break
            at = found.end()
            closing, tag, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
            if not tag:
                continue
            tag = tag.lower()
            if closing:
                if tag == "br":
                    pieces.append(" ")
                elif open_.get(tag):
                    while True:
                        top = stack[-1][0]
                        pop()
                        if top == tag:
                            break
                    if tag not in _INLINE:
                        block += 1
                elif tag == "a" and links > 0:
                    links -= 1
                elif tag not in _INLINE and tag not in ("html", "body"):
                    flush()
                    block += 1
                continue
            if tag in _RAW:
                end = _END[tag].search(page, at)
                at = end.start() if end else len(page)
                continue
            if tag in _VOID:
                if tag == "hr":
                    flush()
                    block += 1
                else:
                    pieces.append(" " if tag == "br" else "")
                continue
            groups = _groups(attributes) if "=" in attributes else 0
            dropped = stack[-1][2] or tag in _DROPPED or bool(attributes and _HIDDEN.search(attributes))
            if tag in _INLINE and not groups and not (dropped and not stack[-1][2]):
                # not a node of its own; a link counts for the text in it
                links += tag == "a" and not stack[-1][2]
                continue
            if tag not in _INLINE and tag not in _DROPPED:
                flush()
                while open_.get("p"):
                    pop()
                closes = _CLOSES.get(tag)
                if closes:
                    while any(open_.get(x) for x in closes) and stack[-1][0] not in FENCES:
                        pop()
                block += 1
            flush()
            stack.append((tag, self._node(stack[-1][1], tag, groups), dropped))
            open_[tag] = open_.get(tag, 0) + 1
            if tag == "a":
                links += 1
            if tag in ("html", "body") and open_[tag] > 1:
                pop()
        while len(stack) > 1:
            pop()
        flush()


def forest_of(pages: list[str]) -> Forest:
    made = Forest()
    for page in pages:
        made.add(page)
    return made


def _binned(x: np.ndarray, edges) -> np.ndarray:
    return np.searchsorted(np.asarray(edges), x, side="right")


_LENGTHS = [1, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 8192]
_SHARES = [0.001, 0.1, 0.25, 0.5, 0.75, 0.95]
_COUNTS = [1, 2, 3, 5, 10, 20, 50]
_PUNCTUATION = re.compile(r"[.,;:!?。、，！？]")
#: (slot, number of values): parameters of slot k begin where those of k - 1 end; value 0 of the names' slots is no evidence.
_SLOTS = [2 * (len(TAGS) + 2), 2 * 12, 2 * 7, 2 * 8, 2 * 8, 2 * 7] + [2] * _GROUPS
_OFFSETS = np.cumsum([0, *_SLOTS])


class Evidence:
    """A forest's features as one number for each slot of each node, and its levels."""

    def __init__(self, forest: Forest):
        self.parent, self.kind = np.array(forest.parent, np.int64), np.array(forest.kind, np.int64)
        depth, page = np.array(forest.depth, np.int64), np.array(forest.page, np.int64)
        n, leaf = len(self.parent), np.array(forest.leaf, np.int64)
        tag = np.array(forest.tag, np.int64)
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(depth.max(initial=-1) + 2))
        self.levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        chars, linked, leaves, marks = (np.zeros(n) for _ in range(4))
        stripped = [t.strip() for t in forest.text]
        chars[leaf] = [len(t) for t in stripped]
        linked[leaf] = np.minimum(forest.linked, chars[leaf]) if len(leaf) else 0
        marks[leaf] = [len(_PUNCTUATION.findall(t)) for t in stripped]
        leaves[leaf] = 1
        for level in self.levels[:0:-1]:
            for x in (chars, linked, leaves, marks):
                np.add.at(x, self.parent[level], x[level])
        self.chars = chars
        own = np.zeros(n, np.int64)  # 1 for leaves, whose parameters are others than those of elements
        own[leaf] = 1
        whole = np.zeros(len(forest.roots))
        whole[page[forest.roots]] = chars[forest.roots]
        up = np.maximum(self.parent, 0)
        named = np.where(own == 1, tag[up], tag)
        ends = np.zeros(n)
        ends[leaf] = [t[-1:] in ".!?…:\"»”。！？" for t in stripped]
        slots = [
            own * (len(TAGS) + 2) + named,
            own * 12 + _binned(chars, _LENGTHS),
            own * 7 + _binned(linked / np.maximum(chars, 1), _SHARES),
            own * 8 + np.minimum(_binned(marks / np.maximum(chars, 1), [0.001, 0.005, 0.01, 0.02, 0.04, 0.08]), 7),
            own * 8 + np.where(own == 1, ends.astype(np.int64), _binned(leaves, _COUNTS)),
            own * 7 + _binned(chars / np.maximum(whole[page], 1), _SHARES),
        ]
        bits = np.array(forest.groups, np.int64)
        slots += [(bits >> k) & 1 for k in range(_GROUPS)]
        self.slots = np.stack(slots, axis=1) + _OFFSETS[:-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


@dataclass
class Model:
    """``weights``: what each feature value says for main text; ``tables[kind, parent's state, state]``."""

    weights: np.ndarray
    tables: np.ndarray

    def potentials(self, seen: Evidence) -> np.ndarray:
        score = self.weights[seen.slots].sum(1)
        return np.stack([-score / 2, score / 2], axis=1)

    def messages(self, seen: Evidence):
        """(log marginals of nodes, log marginals of (parent, node) pairs, log of the sum over all markings of each tree)."""
        unary, pair = self.potentials(seen), self.tables[seen.kind]
        below = unary.copy()  # a node's own evidence and that of all below it
        sent = np.zeros_like(unary)  # from each node to its parent
        for level in seen.levels[:0:-1]:
            sent[level] = _log_sum(pair[level] + below[level][:, None, :], 2)
            np.add.at(below, seen.parent[level], sent[level])
        above = np.zeros_like(unary)
        both = np.zeros((len(unary), 2, 2))
        for level in seen.levels[1:]:
            up = seen.parent[level]
            rest = above[up] + below[up] - sent[level]
            both[level] = rest[:, :, None] + pair[level] + below[level][:, None, :]
            above[level] = _log_sum(rest[:, :, None] + pair[level], 1)
        total = above + below
        z = _log_sum(total, 1)
        return total - z[:, None], both - z[:, None, None], z

    def marginals(self, seen: Evidence) -> np.ndarray:
        return np.exp(self.messages(seen)[0][:, 1]) if len(seen.parent) else np.zeros(0)


def fit_trees(forest: Forest, main: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Weights by the likelihood's gradient. ``main``: of each leaf, whether it is main text."""
    seen = Evidence(forest)
    n, leaf = len(seen.parent), np.array(forest.leaf, np.int64)
    good = np.zeros(n)
    good[leaf] = seen.chars[leaf] * main
    for level in seen.levels[:0:-1]:
        np.add.at(good, seen.parent[level], good[level])
    # an element is what most of its text is, but a page as a whole is never main text
    state = ((2 * good > seen.chars) & (seen.kind != _KIND["body"])).astype(np.int64)
    for level in seen.levels[1:]:  # an element without text goes with its parent
        empty = level[seen.chars[level] == 0]
        state[empty] = state[seen.parent[empty]]
    inner = seen.parent >= 0
    kinds, up = seen.kind[inner], seen.parent[inner]
    own = np.zeros((len(_KIND_NAMES), 2, 2))
    np.add.at(own, (kinds, state[up], state[inner]), 1)
    size, pages = int(_OFFSETS[-1]), len(forest.roots)
    x = np.zeros(size + own.size)
    first, second = np.zeros_like(x), np.zeros_like(x)
    unseen = np.zeros(size, bool)
    unseen[_OFFSETS[-1 - _GROUPS : -1]] = True  # not to be named isn't evidence
    for k in range(1, rounds + 1):
        model = Model(x[:size], x[size:].reshape(own.shape))
        nodes, pairs, _ = model.messages(seen)
        off = state - np.exp(nodes[:, 1])
        g = np.bincount(seen.slots.ravel(), weights=np.repeat(off, seen.slots.shape[1]), minlength=size)
        g[unseen] = 0
        expected = np.zeros_like(own)
        np.add.at(expected, kinds, np.exp(pairs[inner]))
        g = np.concatenate([g, (own - expected).ravel()]) / pages - DECAY * x
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        x = x + 0.1 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    return Model(x[:size], x[size:].reshape(own.shape))


def block_texts(forest: Forest, kept: np.ndarray) -> list[str]:
    """Each page's kept blocks: white space in a block is one space, blocks are joined by line ends."""
    out = [[] for _ in forest.roots]
    current, last = [], None
    for k in np.flatnonzero(kept):
        key = (forest.page[forest.leaf[k]], forest.block[k])
        if key != last and current:
            out[last[0]].append(" ".join("".join(current).split()))
            current = []
        last = key
        current.append(forest.text[k])
    if current:
        out[last[0]].append(" ".join("".join(current).split()))
    return ["\n".join(b for b in blocks if b) for blocks in out]


def marked_by_text(forest: Forest, texts: list[str]) -> np.ndarray:
    """Of each leaf, whether the block that it is part of is a line of its page's text."""
    lines = [set(t.split("\n")) for t in texts]
    whole: dict[tuple[int, int], list[str]] = {}
    keys = [(forest.page[v], b) for v, b in zip(forest.leaf, forest.block, strict=True)]
    for key, t in zip(keys, forest.text, strict=True):
        whole.setdefault(key, []).append(t)
    found = {key: " ".join("".join(ts).split()) in lines[key[0]] for key, ts in whole.items()}
    own = [" ".join(t.split()) in lines[key[0]] for key, t in zip(keys, forest.text, strict=True)]
    return np.array([found[key] or o for key, o in zip(keys, own, strict=True)], bool)


def marked_by_markup(forest: Forest) -> tuple[np.ndarray, np.ndarray]:
    """(of each leaf, whether it is in an article or main element and nothing between says otherwise; of each page, whether it has both sorts)."""
    inside, apart = {_TAG_ID["article"], _TAG_ID["main"]}, {_TAG_ID[t] for t in ("nav", "aside", "footer", "form", "header")}
    state = np.zeros(len(forest.parent), np.int8)
    for v, p in enumerate(forest.parent):
        if p >= 0:
            state[v] = state[p]
        if forest.tag[v] in apart or forest.groups[v] & _APART:
            state[v] = -1
        elif forest.tag[v] in inside and state[v] == 0:
            state[v] = 1
    main = np.array([state[v] == 1 for v in forest.leaf], bool)
    page = np.array([forest.page[v] for v in forest.leaf], np.int64)
    n = len(forest.roots)
    return main, (np.bincount(page[main], minlength=n) > 0) & (np.bincount(page[~main], minlength=n) > 0)


def _escaped(words: list[str]) -> str:
    return entities.escape(" ".join(words))


def made_over(blocks: list[str], other: list[str], words: list[str], rng: random.Random) -> tuple[str, str]:
    """(html, text): the blocks as the article of a page in some layout, with the usual things around and between them.

    ``other`` are blocks of other pages, which readers' comments and teasers are made of, ``words`` what menus say.
    """
    some = lambda a, b: [rng.choice(words) for _ in range(rng.randint(a, b))]
    pick = rng.choice
    attr = lambda *names: pick((f' class="{pick(names)}"', f' id="{pick(names)}"', f' class="{pick(("box", "col", "block", "region"))} {pick(names)}"'))
    links = lambda a, b: "".join(f'<li><a href="#">{_escaped(some(1, 3))}</a></li>' for _ in range(rng.randint(a, b)))
    line = lambda: _escaped(some(4, 25)) + pick((".", "", "!"))
    lead = lambda: entities.escape(pick(other))

    def menu():
        row = " | ".join(f'<a href="#">{_escaped(some(1, 2))}</a>' for _ in range(rng.randint(3, 8)))
        return pick((f"<nav><ul>{links(3, 9)}</ul></nav>", f"<div{attr('menu', 'navbar', 'main-nav', 'navigation')}><ul>{links(3, 9)}</ul></div>", f"<div{attr('breadcrumb', 'breadcrumbs')}>{row}</div>", f"<p>{row}</p>", f"<ul>{links(3, 9)}</ul>"))

    def header():
        inner = f"<div{attr('logo', 'branding')}>{_escaped(some(1, 4))}</div>" + (menu() if rng.random() < 0.6 else "")
        return pick((f"<header>{inner}</header>", f"<div{attr('header', 'masthead', 'topbar', 'site-header')}>{inner}<p>{line()}</p></div>"))

    def notice():
        body = f"<p>{line()} <a href='#'>{_escaped(some(1, 2))}</a></p>" + pick(("", "<button>OK</button>"))
        return pick((f"<div{attr('cookie-notice', 'consent', 'gdpr', 'alert', 'notice', 'popup', 'cookie-banner', 'modal')}>{body}</div>", f'<div role="alert">{body}</div>', f'<section role="dialog">{body}</section>'))

    def advert():
        body = pick((line(), f"<p>{line()}</p>", f"<a href='#'>{line()}</a>", lead()))
        return pick((f"<div{attr('ad', 'ads', 'advert', 'sponsored', 'promo', 'ad-slot', 'advertisement')}>{body}</div>", f"<aside{attr('promo', 'ad')}>{body}</aside>", f'<ins class="adsbygoogle">{body}</ins>'))

    def sidebar():
        inner = f"<h3>{_escaped(some(1, 4))}</h3>" + pick((f"<ul>{links(3, 8)}</ul>", f"<p>{line()}</p>", f"<p>{lead()}</p>", menu()))
        return pick((f"<aside>{inner}</aside>", f"<div{attr('sidebar', 'related', 'widget', 'secondary', 'popular')}>{inner}</div>", f"<section{attr('related', 'recommended', 'sidebar')}>{inner}</section>"))

    def form():
        inner = f"<label>{_escaped(some(1, 4))}</label><input name=q><p>{line()}</p><button>{_escaped(some(1, 2))}</button>"
        return pick((f"<form>{inner}</form>", f"<form{attr('search-form', 'newsletter', 'subscribe')}>{inner}</form>", f"<div{attr('newsletter', 'signup', 'login')}><form>{inner}</form></div>"))

    def comments():
        each = pick(("<li>{}</li>", "<div>{}</div>", '<div class="comment">{}</div>', "<li><p>{}</p></li>", "<article>{}</article>"))
        inner = f"<h2>{_escaped(some(1, 3))}</h2><ol>" + "".join(each.format(f"<b>{_escaped(some(1, 2))}</b> <p>{lead()}</p>") for _ in range(rng.randint(1, 5))) + "</ol>" + pick(("", form()))
        return pick((f"<section{attr('comments', 'discussion')}>{inner}</section>", f"<div{attr('comments', 'comment-list', 'disqus', 'responses')}>{inner}</div>", f'<ol class="commentlist">{inner}</ol>'))

    def share():
        return pick((f"<div{attr('share', 'social', 'share-buttons', 'follow')}><ul>{links(2, 5)}</ul></div>", f"<ul{attr('social', 'sharing')}>{links(2, 5)}</ul>"))

    def footer():
        body = f"&copy; {_escaped(some(1, 4))} &middot; {line()}"
        return pick((f"<footer>{body}</footer>", f"<div{attr('footer', 'site-footer', 'colophon', 'copyright')}><p>{body}</p><ul>{links(0, 5)}</ul></div>", f"<p><small>{body}</small></p>"))

    def article():
        inner = []
        for k, b in enumerate(blocks):
            safe = entities.escape(b)
            if k == 0 and rng.random() < 0.7:
                inner.append(f"<h1>{safe}</h1>")
            elif len(b) < 90 and rng.random() < 0.5:
                inner.append(pick((f"<h2>{safe}</h2>", f"<ul><li>{safe}</li></ul>", f"<h3>{safe}</h3>")))
            else:
                inner.append(pick((f"<p>{safe}</p>",) * 6 + (f"<p>{safe}", f"<div>{safe}</div>", f"<blockquote><p>{safe}</p></blockquote>", f"<p><b>{safe}</b><br></p>", f"<pre>{safe}</pre>", f"<p><a href='#'>{safe[:0]}</a>{safe}</p>")))
            if rng.random() < 0.12:
                inner.append(pick((advert, advert, share, sidebar, notice))())
        if rng.random() < 0.25:
            inner.append(pick((comments, share, form, sidebar))())
        body = "\n".join(inner)
        return pick((
            f"<article>{body}</article>", f"<main><article>{body}</article></main>", f"<main>{body}</main>", f"<article><div{attr('body', 'content', 'text')}>{body}</div></article>",
            f"<div{attr('post-content', 'entry-content', 'article-body', 'story', 'content', 'main', 'post', 'news-text')}>{body}</div>", f"<section{attr('story', 'article', 'content')}>{body}</section>",
            f"<table><tr><td>{menu()}</td><td>{body}</td></tr></table>", f"<div>{body}</div>", f"<div><div>{body}</div></div>",
        ))

    before = [f() for f in (header, menu, notice, advert, form, share) if rng.random() < 0.45]
    after = [f() for f in (sidebar, comments, advert, form, share, footer, notice) if rng.random() < 0.45]
    rng.shuffle(before)
    core = "\n".join([*before, article(), *after])
    core = pick((core,) * 6 + (f"<div{attr('wrapper', 'page', 'container')}>{core}</div>", f'<form id="aspnetForm">{core}</form>', f"<div><div>{core}</div></div>"))
    return f"<html><head><title>{entities.escape(blocks[0])}</title></head><body>{core}{pick(('</body></html>', ''))}", "\n".join(" ".join(b.split()) for b in blocks)


def learned(pages: list[str], texts: list[str] | None = None, *, layouts: int = LAYOUTS, rounds: int = ROUNDS, seed: int = 13) -> Model:
    """A model of labelled pages: with their texts, or by their own markup."""
    forest = forest_of(pages)
    if texts is None:
        main, fine = marked_by_markup(forest)
        fine = np.flatnonzero(fine)
        sources = block_texts(forest, main)
        pages, texts = [pages[k] for k in fine], [sources[k] for k in fine]
    rng = random.Random(seed)
    apart = [w for t in texts for w in t.split()[:40]] or "about all contact home index more news our press read search terms".split()
    blocks = [[b for b in t.split("\n") if b] for t in texts] or [["A heading", "A sentence of a page, and what else it says. There is more of it.", "The last one ends here."]]
    blocks = [b for b in blocks if b]
    others = [b for page in blocks for b in page[1:3]] or ["A remark of a reader, who says what comes to mind."]
    made = [made_over(b[: rng.randint(1, 12)], [o[: rng.choice((60, 200, 500))] for o in rng.choices(others, k=8)], apart, rng) for b in blocks for _ in range(layouts)]
    whole = forest_of([*pages, *(h for h, _ in made)])
    return fit_trees(whole, marked_by_text(whole, [*texts, *(t for _, t in made)]), rounds)


def fit(pages: DataFrame, *, html: str = "html", text: str | None = None, max_pages: int = MAX_PAGES, max_chars: int = MAX_CHARS) -> Model:
    """A model learned from at most ``max_pages`` pages of at most ``max_chars`` characters, the smallest by a hash of their html.

    With ``text`` that column has each page's main text, a block a line; without, the pages' own markup says what it is.
    Repeated pages count once. An empty table, or one without such pages, gives a model of made-over pages alone.
    """
    own = [F.col(html).cast("string").alias("h"), *([whole_text(text).alias("t")] if text else [])]
    rows = pages.select(*own).where(F.col("h").isNotNull() & (F.length("h") <= max_chars)).withColumn("k", F.xxhash64("h"))
    # which ones, before any page travels
    keys = [r.k for r in rows.select("k").distinct().orderBy("k").limit(max_pages).collect()]
    chosen = rows.where(F.col("k").isin(keys)).groupBy("k").agg(F.min(F.struct(*[c for c in rows.columns if c != "k"])).alias("page")).collect()
    chosen = [r.page for r in sorted(chosen, key=lambda r: r.k)]
    return learned([r.h for r in chosen], [r.t for r in chosen] if text else None)


def main_texts(pages: list[str], model: Model) -> list[str]:
    forest = forest_of(pages)
    if not forest.leaf:
        return [""] * len(pages)
    chance = model.marginals(Evidence(forest))
    return block_texts(forest, chance[np.array(forest.leaf)] >= THRESHOLD)


def extract(pages: DataFrame, model: Model, *, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of ``pages``.

    Null and empty html give the empty text, as do pages without main text. Ids and urls pass as they are, nulls and
    repeated ones too; equal pages have equal texts. Pages are read whole, whatever their length. An empty table stays
    empty; other columns, whatever their names, are left out.
    """
    spark = pages.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url)}

    def run(batches):
        for batch in batches:
            made = main_texts(batch.column("html").to_pylist(), held.value)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(made, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), whole_text(html).alias("html"))
    return rows.mapInArrow(run, f"page_id {kinds[id_col]}, url {kinds[url]}, text string").withColumn("n_chars", F.length("text").cast("long"))
