"""Main text of web pages: a linear-chain conditional random field over the
leaf blocks of the document tree, decoded by Viterbi.

``blocks`` walks the markup once and yields the leaf blocks in page order: a
block is the text between two block-level tags, with the path of elements
above it.  Scripts, styles, comments, form controls and the head are no text.
Every block has ancestor features (each tag above it, the nearest sectioning
tag, its parent, words of class, id and role names above it, those of the
nearest named element) and text features (words, link share, punctuation,
separators, headings before it).  The field has a weight per feature and a
weight per pair of neighbouring labels, one set for neighbours with one parent
and one for others.

Labels: pages are labelled in two ways.  Of the table's own pages, those that
mark their article (``article``, ``main``) label themselves; at most
``TRAIN_PAGES`` of them, the first by hash, are taken, and of each at most
``TRAIN_BLOCKS`` blocks.  ``LAYOUTS`` pages are made from the layouts below, which
say of each part whether it is main text, with wording taken from those pages'
blocks; so the field also knows pages that mark nothing.  Fitting (forward-
backward, gradient steps) runs on the driver on these bounded pages; both
bounds are parameters of ``fit``.

Text: character references decoded, white space inside a block (inline tags
and ``br`` do not end one) turned into one space, trimmed; main blocks joined
in page order by one space; nothing else is dropped or cut.

Scale: one pass over the pages, no shuffle; a page's cost is linear in its
length, and ancestor scores are kept per element, whatever the depth.  Only
the fitted weights (a few hundred) go to the tasks.

Rows: null html is empty; null page_id and url stay; a page without main text
gives an empty string; very long pages are read whole; repeated rows are
repeated; extra columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import random
import re
from html import escape, unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickspark.llm.common import map_rows, table

#: Training pages from the table, blocks of each, and pages made from layouts.
TRAIN_PAGES, TRAIN_BLOCKS, LAYOUTS = 200, 60, 900
#: Characters of a training page at most.
TRAIN_CHARS = 50000

# ---- fixed values of HTML ----
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes noscript xmp".split())
UNSEEN = frozenset("head template svg math select datalist button object video audio canvas map".split())
SECTIONS = frozenset("article main nav aside header footer form section dialog menu search body".split())
#: What a start tag ends: elements up to the nearest of the second set.
_ITEMS = frozenset("ul ol menu dir table".split())
_CELLS = frozenset(["table"])
ENDS = {"li": (frozenset(["li"]), _ITEMS), "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
        "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])), "tr": (frozenset(["tr"]), _CELLS),
        "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
        "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
        "tbody": (frozenset(["thead", "tbody", "tfoot"]), _CELLS), "tfoot": (frozenset(["thead", "tbody", "tfoot"]), _CELLS),
        "option": (frozenset(["option"]), frozenset(["select"])), "body": (frozenset(["head"]), frozenset(["body"]))}
_BARRIER = frozenset("td th caption table".split())

_MARK = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+>?|</?([a-zA-Z][^\s/>]*+)"
                   r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|))*+)>?", re.S)
_NAMES = re.compile(r"(?:^|[\s\"'/])(class|id|role|itemprop|style|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?",
                    re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _named(attrs: str) -> tuple[str, ...]:
    """Words of an element's class, id, role and itemprop; ``hidden``."""
    out = []
    for name, value in _NAMES.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                out.append("hidden")
        elif name in ("hidden", "aria-hidden"):
            if value.lower() != "false":
                out.append("hidden")
        else:
            out += [w.lower().removesuffix("s") for w in _WORD.findall(value) if len(w) > 1]
    return tuple(dict.fromkeys(out))


class Node:
    """An open element; elements of one kind below one parent share a node."""

    __slots__ = ("up", "tag", "unseen", "names", "near", "section", "kids", "known")

    def __init__(self, up: Node | None, tag: str, names: tuple[str, ...]):
        self.up, self.tag, self.kids, self.known = up, tag, {}, None
        self.names = names if tag not in ("html", "body") else ()
        self.unseen = tag in UNSEEN or up is not None and up.unseen
        self.near = self.names or (up.near if up else ())
        self.section = tag if tag in SECTIONS else up.section if up else ""

    def kid(self, tag: str, names: tuple[str, ...]) -> Node:
        k = self.kids.get((tag, names))
        if k is None:
            k = self.kids[tag, names] = Node(self, tag, names)
        return k

    def own(self) -> list[str]:
        return ["t:" + self.tag, *("c:" + n for n in self.names)]

    def local(self) -> list[str]:
        return ["p:" + self.tag, "s:" + self.section, *("n:" + n for n in self.near)]


def blocks(html: str):
    """(node, text, linked characters) of the leaf blocks in page order."""
    node, text, linked, link, at, n = Node(None, "", ()), [], 0, False, 0, len(html)

    def flush():
        nonlocal linked
        out = " ".join("".join(text).split()) if text else ""
        text.clear()
        linked, was = 0, linked
        return (node, out, was) if out else None

    def upto(tags, barrier):
        """The node above the nearest open one of ``tags``; None if a barrier
        comes first or none is open."""
        x = node
        while x is not None and x.tag not in barrier:
            if x.tag in tags:
                return x.up
            x = x.up
        return None

    opened: dict[str, int] = {}

    def leave(to):
        nonlocal node
        while node is not to:
            opened[node.tag] -= 1
            node = node.up

    while at < n:
        lt = html.find("<", at)
        m = None
        while lt >= 0:
            m = _MARK.match(html, lt)
            if m:
                break
            if html.startswith("</", lt):  # no name: a comment up to >
                end = html.find(">", lt)
                m = re.compile(r".*", re.S).match(html, lt, n if end < 0 else end + 1)
                break
            lt = html.find("<", lt + 1)
        stop = n if m is None else lt
        if stop > at and not node.unseen:
            piece = unescape(html[at:stop])
            text.append(piece)
            if link:
                linked += len(piece)
        if m is None:
            break
        at = m.end()
        tag = m.group(1) if m.re is _MARK else None
        if tag is None:
            continue
        tag, closing = tag.lower(), html[lt + 1] == "/"
        if closing and tag == "br":
            closing = False
        if tag in INLINE:
            if tag == "a":
                link = not closing
            elif tag == "br":
                text.append(" ")
            continue
        if tag in RAW:
            if not closing:
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
                at = n if end is None else end.end()
            continue
        if "-" in tag or tag in ("html",) and opened.get("html"):
            continue  # custom elements are inline
        if closing and tag != "p" and not opened.get(tag):
            continue
        if (b := flush()) is not None:
            yield b
        link = False
        if closing:
            if opened.get(tag):
                to = upto((tag,), _BARRIER - {tag} if tag != "table" else ())
                if to is not None:
                    leave(to)
            continue
        if tag in VOID:
            continue
        if node.tag == "p":
            leave(node.up)
        elif tag == "option" and node.tag == "option":
            leave(node.up)
        ends = ENDS.get(tag)
        if ends and any(opened.get(t) for t in ends[0]):
            to = upto(*ends)
            if to is not None:
                leave(to)
        node = node.kid(tag, _named(m.group(2)) if m.group(2) else ())
        opened[tag] = opened.get(tag, 0) + 1
    if (b := flush()) is not None:
        yield b


# ---- features ----
_NOTICE = re.compile(r"\b(?:cookies?|consent|subscribe|newsletter|sign (?:in|up)|log ?in|advert\w*|sponsored|share|privacy|"
                     r"terms of|copyright|rights reserved|related|comments?|repl(?:y|ies)|read more|menu|search)\b|©|&copy", re.I)


def _band(x: int, edges: tuple[int, ...]) -> int:
    return sum(x >= e for e in edges)


def text_features(text: str, linked: int, headed: bool, first: bool) -> list[str]:
    n = text.count(" ") + 1
    out = ["bias", f"words{_band(n, (2, 5, 10, 25, 50, 100))}", "headed" if headed else "unheaded",
           f"links{_band(100 * linked // len(text), (1, 34, 67))}", f"stops{_band(text.count('. ') + text.count(', '), (1, 3, 8))}"]
    if text[-1] in ".!?。…\"”":
        out.append("ends")
    if first:
        out.append("first")
    if any(c in text for c in "|·•»›→"):
        out.append("marks")
    if n < 40 and _NOTICE.search(text):
        out.append("notice")
    return out


_HEADS = frozenset(["h1", "h2"])


class Model:
    """Weights of the field.  Unknown features weigh nothing."""

    def __init__(self, weights: dict[str, float], links: np.ndarray, start: float):
        self.weights, self.links, self.start = weights, links.tolist(), start

    def above(self, node: Node) -> tuple[frozenset, float]:
        """The known ancestor features of an element and their weight."""
        todo = []
        while node is not None and node.known is None:
            todo.append(node)
            node = node.up
        seen, total = node.known[:2] if node else (frozenset(), 0.0)
        w = self.weights
        for x in reversed(todo):
            new = [f for f in dict.fromkeys(x.own()) if f in w and f not in seen]
            if new:
                seen, total = seen | frozenset(new), total + sum(w[f] for f in new)
            x.known = seen, total, total + sum(w.get(f, 0.0) for f in x.local())
            node = x
        return node.known

    def labels(self, html: str) -> tuple[list[str], list[bool]]:
        """A page's blocks and whether each is main text: the likeliest labels."""
        texts, back, headed, old = [], [], False, None
        score = [0.0, self.start]
        for node, text, linked in blocks(html):
            headed = headed or node.tag in _HEADS
            here = self.above(node)[2]
            for f in text_features(text, linked, headed, not texts):
                here += self.weights.get(f, 0.0)
            if old is None:
                score, step = [score[0], score[1] + here], (0, 0)
            else:
                t = self.links[node.up is old.up and node.section == old.section]
                a, b = (score[0] + t[0][0], score[1] + t[1][0]), (score[0] + t[0][1], score[1] + t[1][1])
                step = (int(a[1] > a[0]), int(b[1] > b[0]))
                score = [max(a), max(b) + here]
            back.append(step)
            texts.append(text)
            old = node
        out, y = [], int(score[1] > score[0])
        for step in reversed(back):
            out.append(bool(y))
            y = step[y]
        return texts, out[::-1]

    def main_text(self, html: str | None) -> str:
        texts, main = self.labels(html or "")
        return " ".join(t for t, m in zip(texts, main) if m)


# ---- labelled pages ----
# Parts of pages, as (tag, attributes); fixed values.
MAIN = [("article", ""), ("main", ""), ("div", 'class="content"'), ("div", 'id="main-content"'), ("div", 'class="post-body"'),
        ("div", 'class="entry-content"'), ("div", 'class="article-body"'), ("section", 'class="story"'),
        ("div", 'class="post"'), ("div", 'class="text"'), ("div", 'id="content"'), ("article", 'class="post"'),
        ("div", 'class="page-content"'), ("div", 'itemprop="articleBody"'), ("div", 'role="main"'), ("section", ""),
        ("div", 'class="article"'), ("div", 'id="main"'), ("td", 'class="content"'), ("div", 'class="body"'), ("div", "")]
INSIDE = [("div", ""), ("section", ""), ("div", 'class="section"'), ("div", 'class="row"'), ("blockquote", ""), ("div", 'class="text"')]
LINKS = [("nav", ""), ("nav", 'class="menu"'), ("div", 'class="menu"'), ("div", 'class="navbar"'), ("div", 'id="nav"'),
         ("div", 'class="navigation"'), ("div", 'class="breadcrumbs"'), ("ul", 'class="breadcrumb"'), ("div", 'class="pagination"'),
         ("div", 'role="navigation"'), ("aside", ""), ("div", 'class="sidebar"'), ("div", 'id="sidebar"'), ("aside", 'class="related"'),
         ("div", 'class="related-posts"'), ("div", 'class="tags"'), ("div", 'class="widget"'), ("div", 'class="trending"'),
         ("div", 'class="recommended"'), ("div", 'class="share"'), ("div", 'class="social-links"'), ("menu", ""), ("header", ""),
         ("footer", ""), ("section", 'class="related"'), ("div", 'class="toolbar"'), ("div", 'class="topbar"'), ("div", "")]
PROSE = [("div", 'class="ad"'), ("div", 'class="ads"'), ("div", 'class="advert"'), ("div", 'class="advertisement"'),
         ("aside", 'class="ad"'), ("div", 'class="sponsored"'), ("div", 'class="promo"'), ("div", 'class="banner"'),
         ("div", 'class="cookie-notice"'), ("div", 'id="cookie-banner"'), ("div", 'class="consent"'), ("div", 'class="gdpr"'),
         ("div", 'class="notice"'), ("div", 'class="alert"'), ("div", 'role="alert"'), ("div", 'role="dialog"'), ("dialog", ""),
         ("div", 'class="popup"'), ("div", 'class="modal"'), ("div", 'class="overlay"'), ("div", 'class="newsletter"'),
         ("div", 'class="subscribe"'), ("div", 'class="signup"'), ("div", 'class="disclaimer"'), ("form", ""), ("form", 'class="search"'),
         ("form", 'class="login"'), ("header", ""), ("header", 'class="site-header"'), ("div", 'class="header"'),
         ("div", 'id="header"'), ("div", 'class="masthead"'), ("footer", ""), ("footer", 'class="site-footer"'),
         ("div", 'class="footer"'), ("div", 'id="footer"'), ("div", 'class="copyright"'), ("div", 'class="legal"'), ("aside", ""),
         ("aside", 'class="sidebar"'), ("div", 'class="sidebar"'), ("div", 'class="author-bio"'), ("div", 'role="complementary"'),
         ("div", 'role="contentinfo"'), ("div", 'role="banner"'), ("div", "hidden"), ("div", 'style="display:none"')]
TALK = [("div", 'class="comments"'), ("section", 'class="comments"'), ("section", 'id="comments"'), ("div", 'id="comments"'),
        ("ol", 'class="comment-list"'), ("div", 'class="reader-comments"'), ("div", 'class="discussion"'),
        ("div", 'class="responses"'), ("div", 'class="replies"'), ("div", 'id="disqus_thread"')]
REMARK = [("div", 'class="comment"'), ("li", 'class="comment"'), ("article", 'class="comment"'), ("div", 'class="reply"'),
          ("p", ""), ("div", "")]


class _Pages:
    """Pages with known main text, from the layouts and given sentences."""

    def __init__(self, texts: list[str], seed: int):
        self.rng, self.texts = random.Random(seed), texts or ["Some words of a page that says little, but says it well."]

    def pick(self, parts):
        return self.rng.choice(parts)

    def words(self, low, high):
        w = self.pick(self.texts).split()
        i = self.rng.randrange(max(1, len(w)))
        return escape(" ".join(w[i:i + self.rng.randint(low, high)]) or "word", quote=False)

    def block(self, tag, text, main):
        self.out.append((text, main))
        return f"<{tag}>{text}</{tag}>"

    def wrap(self, part, body):
        tag, attrs = part
        if tag == "td":
            return f"<table><tr><td {attrs}>{body}</td></tr></table>"
        return f"<{tag} {attrs}>{body}</{tag}>"

    def links(self, inner="li"):
        out = ""
        for _ in range(self.rng.randint(2, 8)):
            t = self.words(1, 3)
            self.out.append((t, False))
            out += f"<{inner}><a href='#'>{t}</a></{inner}>"
        return f"<ul>{out}</ul>" if inner == "li" else out

    def junk(self):
        r = self.rng.random()
        if r < 0.45:
            part = self.pick(LINKS)
            return self.wrap(part, self.links("li" if part[0] not in ("ul", "menu") else "li"))
        if r < 0.85:
            part, kind = self.pick(PROSE), self.rng.random()
            body = "" if kind < 0.35 else "".join(
                self.block(self.pick(("p", "div", "p", "h3", "h1" if "head" in "".join(part) else "p")),
                           self.words(*self.pick(((1, 6), (5, 20), (15, 60)))), False) for _ in range(self.rng.randint(1, 3)))
            if kind < 0.5:  # bare text
                t = self.words(*self.pick(((1, 6), (5, 25), (15, 60))))
                self.out.append((t, False))
                body += t
            return self.wrap(part, body)
        return self.talk()

    def talk(self):
        body = self.block("h2", self.words(1, 3), False) if self.rng.random() < 0.6 else ""
        for _ in range(self.rng.randint(1, 5)):
            kind = self.pick(REMARK)
            t = self.words(3, 60)
            self.out.append((t, False))
            body += self.wrap(kind, t if kind[0] == "p" or self.rng.random() < 0.4 else f"<p>{t}</p>")
        return self.wrap(self.pick(TALK), body)

    def body(self):
        rng, out = self.rng, ""
        if rng.random() < 0.8:
            h = self.block(self.pick(("h1", "h1", "h1", "h2")), self.words(2, 12), True)
            out += f"<header>{h}</header>" if rng.random() < 0.1 else h
        for _ in range(rng.randint(1, 9)):
            r = rng.random()
            if r < 0.54:
                out += self.block("p", self.words(*self.pick(((1, 4), (5, 20), (20, 120), (20, 120)))), True)
            elif r < 0.61:
                out += self.block(self.pick(("h2", "h3", "h4")), self.words(1, 8), True)
            elif r < 0.67:
                out += "<ul>" + "".join(self.block("li", self.words(1, 12), True) for _ in range(rng.randint(1, 5))) + "</ul>"
            elif r < 0.7:
                out += "<table><tr>" + "".join(self.block("td", self.words(1, 4), True) for _ in range(rng.randint(1, 4))) + "</tr></table>"
            elif r < 0.74:
                out += self.block(self.pick(("blockquote", "pre", "figcaption", "dd")), self.words(2, 30), True)
            elif r < 0.78:
                out += self.wrap(self.pick(INSIDE), self.block("p", self.words(3, 60), True))
            elif r < 0.8:
                out += self.block("p", self.words(3, 20).replace(" ", " | "), True)
            else:
                out += self.junk()
        return out

    def page(self):
        """(html, [(text, is main)]) of one page."""
        rng, self.out = self.rng, []
        if rng.random() < 0.04:  # text and nothing else
            if rng.random() < 0.5:
                t = self.words(2, 80)
                self.out.append((t, True))
                return t, self.out
            return "".join(self.block(self.pick(("p", "div")), self.words(5, 60), True) for _ in range(rng.randint(1, 4))), self.out
        top = "".join(self.junk() for _ in range(rng.randint(0, 3)))
        main = self.body()
        if rng.random() < 0.92:
            main = self.wrap(self.pick(MAIN), main)
        if rng.random() < 0.3:
            main = self.wrap(self.pick((("div", 'class="wrapper"'), ("div", 'id="page"'), ("div", 'class="container"'), ("main", ""),
                                        ("div", 'class="content-with-sidebar"'))), main + (self.junk() if rng.random() < 0.5 else ""))
        end = "".join(self.junk() for _ in range(rng.randint(0, 3)))
        return f"<html><body>{top}{main}{end}</body></html>", self.out


def _own_label(node: Node) -> bool | None:
    """What a page's own elements say of a block: inside its article, and not in
    a part of it that has another use."""
    other, inside = False, False
    while node is not None:
        if node.tag in ("article", "main"):
            inside = True
            break
        other = other or node.tag in ("nav", "aside", "footer", "form", "dialog", "menu") or bool(
            {"comment", "ad", "share", "related", "newsletter"} & set(node.names))
        node = node.up
    return inside and not other


def labelled(pages: list[str], layouts: int = LAYOUTS, most: int = TRAIN_BLOCKS, seed: int = 11):
    """Training sequences: lists of (features, same parent as the block before,
    label)."""
    out, texts = [], []

    def sequence(html, label):
        seq, headed, old = [], False, None
        for i, (node, text, linked) in enumerate(blocks(html)):
            if i >= most:
                break
            headed = headed or node.tag in _HEADS
            x, up = set(node.local()), node
            while up is not None:
                x.update(up.own())
                up = up.up
            x.update(text_features(text, linked, headed, not seq))
            seq.append((x, old is not None and node.up is old.up and node.section == old.section, label(i, node)))
            old = node
        return seq

    for html in pages:
        found = list(blocks(html))[:most]
        texts += [t for _, t, _ in found if len(t) > 40]
        if any(_own_label(b[0]) for b in found):
            out.append(sequence(html, lambda i, node: _own_label(node)))
    made = _Pages(texts, seed)
    for _ in range(layouts):
        html, truth = made.page()
        out.append(sequence(html, lambda i, node, t=truth: t[i][1]))
    return [s for s in out if s]


def train(sequences, rounds: int = 300, l2: float = 5e-5) -> Model:
    """Maximum likelihood of the labels under the field: forward-backward over
    all sequences at once, accelerated gradient steps."""
    names: dict[str, int] = {}
    for s in sequences:
        for x, _, _ in s:
            for f in sorted(x):
                names.setdefault(f, len(names))
    if not sequences:
        return Model({}, np.zeros((2, 2, 2)), 0.0)
    p, t = len(sequences), max(map(len, sequences))
    live, kind, y = (np.zeros((t, p), k) for k in (bool, int, int))
    slot, feat = [], []
    for j, s in enumerate(sequences):
        for i, (x, same, label) in enumerate(s):
            live[i, j], kind[i, j], y[i, j] = True, same, label
            slot += [i * p + j] * len(x)
            feat += [names[f] for f in x]
    slot, feat, n = np.array(slot), np.array(feat), int(live.sum())
    w, link, start = np.zeros(len(names)), np.zeros((2, 2, 2)), 0.0
    m1 = [np.zeros_like(w), np.zeros_like(link), 0.0]
    m2 = [np.zeros_like(w), np.zeros_like(link), 0.0]
    both = live[1:] & live[:-1]
    given = np.zeros((2, 2, 2))
    np.add.at(given, (kind[1:][both], y[:-1][both], y[1:][both]), 1)
    for r in range(1, rounds + 1):
        u = np.bincount(slot, w[feat], t * p).reshape(t, p)
        unary = np.stack([np.zeros((t, p)), u], -1)
        unary[0, :, 1] += start
        fwd, bwd = np.empty((t, p, 2)), np.zeros((t, p, 2))
        fwd[0] = unary[0]
        step = link[kind]
        for i in range(1, t):
            new = np.logaddexp(fwd[i - 1][:, 0, None] + step[i][:, 0], fwd[i - 1][:, 1, None] + step[i][:, 1]) + unary[i]
            fwd[i] = np.where(live[i][:, None], new, fwd[i - 1])
        z = np.logaddexp(fwd[-1, :, 0], fwd[-1, :, 1])
        for i in range(t - 2, -1, -1):
            b = bwd[i + 1] + unary[i + 1]
            new = np.logaddexp(step[i + 1][:, :, 0] + b[:, None, 0], step[i + 1][:, :, 1] + b[:, None, 1])
            bwd[i] = np.where(live[i + 1][:, None], new, 0.0)
        prob = np.exp(fwd[..., 1] + bwd[..., 1] - z)
        pair = np.exp(fwd[:-1, :, :, None] + step[1:] + (unary + bwd)[1:, :, None, :] - z[:, None, None])
        expected = np.zeros((2, 2, 2))
        for k in (0, 1):
            expected[k] = pair[both & (kind[1:] == k)].sum(0)
        grads = [np.bincount(feat, np.where(live, prob - y, 0).ravel()[slot], len(names)) / n + l2 * w,
                 (expected - given) / n + l2 * link, float((prob[0] - y[0]).sum()) / n + l2 * start]
        new = []
        for g, a, b, x in zip(grads, (0, 1, 2), (0, 1, 2), (w, link, start)):
            m1[a] = 0.9 * m1[a] + 0.1 * g
            m2[b] = 0.99 * m2[b] + 0.01 * g * g
            new.append(x - 0.15 * (1 - 0.8 * r / rounds) * (m1[a] / (1 - 0.9 ** r)) / (np.sqrt(m2[b] / (1 - 0.99 ** r)) + 1e-8))
        w, link, start = new
    return Model({f: float(w[i]) for f, i in names.items()}, link, float(start))


def fit(pages: DataFrame, train_pages: int = TRAIN_PAGES, layouts: int = LAYOUTS) -> Model:
    """The field, from the first ``train_pages`` different pages by hash and from
    ``layouts`` made pages."""
    took = pages.where(F.length("html") <= TRAIN_CHARS).select("html", F.xxhash64("html").alias("h"))
    least = [r["h"] for r in took.select("h").distinct().orderBy("h").limit(train_pages).collect()]
    # however often a page is repeated, one copy comes here
    rows = took.where(F.col("h") <= least[-1]).groupBy("h").agg(F.min("html").alias("html")).collect() if least else []
    return train(labelled([r["html"] for r in sorted(rows, key=lambda r: r["h"])], layouts))


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_main of every page."""
    model = model or fit(pages)

    def run(batches):
        for b in batches:
            texts, counts, kept = [], [], []
            for html in b["html"]:
                found, main = model.labels(html or "")
                texts.append(" ".join(t for t, m in zip(found, main) if m))
                counts.append(len(found))
                kept.append(sum(main))
            yield {"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts],
                   "n_blocks": counts, "n_main": kept}

    return map_rows(pages.select("page_id", "url", "html"), run,
                    "page_id long, url string, text string, n_chars long, n_blocks long, n_main long")


def query(spark, sf_dir: str) -> DataFrame:
    """op13: the main text of every page."""
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
