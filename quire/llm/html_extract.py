"""Operator 7, HTML extraction: the main text of a page by a linear-chain conditional random field over DOM leaf blocks.

Method: a page is cut into its leaf blocks (stretches of text between block-level tags, implied ends of p, li, td and the
like included); each has features of its ancestors (tags, classes, ids) and of its text (length, share of link text,
punctuation, telling words, place). A linear chain over the labels "main" and "other" is trained by gradient steps on the
exact likelihood (forward-backward) on labelled pages, which labelled_pages() makes with a fixed seed, half from the
hand-written layouts of html_layouts.py and half from parts put together at random; pages are decoded by Viterbi. Where no
block is main on the best path although the page has prose outside of what its tags call navigation, a header, a footer, a form or the like,
the best path with that prose is taken. Training takes a bounded number of small pages, on the driver; its weights go with the task.

Tags follow the HTML standard's tokenizer: a quote inside an unquoted value is part of it, a tag that the page ends in is
dropped with all that it swallowed. The time is in proportion to the page: open elements are found by name, and what an
element adds to its parent's features is kept with it.

In a block white space is one space, references are decoded, br is white space; scripts, styles, templates, drawings (svg),
embedded frames and comments are no text; formulas (math) and what stands in object for want of it are. A null or empty html, or one without a main block,
gives the empty text. Rows are judged one by one, so repeated rows and null page_ids stay as they are; an empty table gives
no rows.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html_layouts import LAYOUTS

#: The rest of a tag after its name: attributes, whose values are quoted or go up to white space or ">".
ATTRIBUTES = re.compile(r"""(?:[\s/]++|=?+[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?![\s"'>])[^\s>]++)?+)?+|=)*+""")
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
CLASS = re.compile(r"(?<![^\s/])(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+))", re.I)
TOKEN = re.compile(r"[a-z]+")
RAW = frozenset(("script", "style", "template", "svg", "iframe", "noframes", "noembed", "xmp"))
#: Elements whose content is text up to their end tag.
PLAIN = frozenset(("title", "textarea"))
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html label legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul video audio canvas".split()
)
#: What an opening tag ends: itself and the like, up to a container.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words that tell of other than main text.
TELLING = re.compile(r"cookie|subscri|newsletter|sign ?up|log ?in|copyright|©|all rights|advert|sponsor|privacy|comment|reply|share|menu|related|read more|click|terms", re.I)
SENTENCE = re.compile(r"[.!?…:;\"'»”)\]。！？：；」』）।؟۔።]$")
#: Letters of scripts that put no spaces between words: Thai, Lao, Burmese, Khmer, Chinese and Japanese.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
LABELS = 2
PAGES = 640
#: Stands before the label of a made block (a character of private use).
MARK = "\ue000"
STEPS = 120


#: An end tag closes nothing beyond one of these, unless it is one itself.
SCOPE = frozenset(("table", "td", "th", "caption"))
#: Words of a path that say that what is inside is no article.
ASIDE = frozenset(f"in={x}" for x in "nav header footer aside form dialog menu button select title head".split()) | frozenset(
    f"in.{x}" for x in "nav menu navigation navbar sidebar footer header masthead banner cookie consent ad ads advert advertisement promo sponsor sponsored comment comments newsletter share social related login breadcrumb breadcrumbs copyright widget".split()
)


class Element:
    """An open element: tag, class and id words, and the features of all that it lies in."""

    __slots__ = ("found", "inner", "key", "score", "tag", "up", "words")

    def __init__(self, up: Element | None, tag: str, words: tuple[str, ...], names: dict[str, int] | None):
        self.tag, self.words, self.up, self.score = tag, words, up, None
        self.inner = words[0] if words else tag if tag in SECTIONS or up is None else up.inner
        more = [f"in={tag}", *(f"in.{w}" for w in words)]
        if names is not None:  # only those that the model knows: a set bounded by the model
            more = [f for f in more if f in names or f in ASIDE]
        above = up.found if up else NOTHING
        more = [f for f in more if f not in above]
        self.found = above.union(more) if more else above

    def features(self) -> list[str]:
        out = {f"own={self.tag}", *(f"own.{w}" for w in self.words), f"inner={self.inner}", *self.found}
        if self.up and self.up.tag != "none":
            out.add(f"up={self.up.tag}")
        return sorted(out)


SECTIONS = frozenset(("article", "main", "nav", "aside", "header", "footer", "form", "section", "dialog"))
NOTHING: frozenset[str] = frozenset()


class Block(NamedTuple):
    at: Element
    text: str
    linked: float


def leaf_blocks(html: str, names: dict[str, int] | None = None) -> list[Block]:
    """The leaf blocks of a page, in order: innermost open element, text, share of it in links. names: features to keep (all)."""
    out: list[Block] = []
    root = Element(None, "none", (), names)
    root.found = NOTHING
    stack: list[Element] = [root]
    where: dict[str, list[int]] = {}  # by tag, the places in the stack
    parts: list[str] = []
    links, linked, at, n = 0, 0, 0, len(html)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(stack[-1], text, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def last(tags) -> int:
        return max([where[t][-1] for t in tags if where.get(t)], default=0)

    def close(tags, until=NOTHING) -> None:
        """Ends the innermost element of tags, with all in it; not beyond one of until."""
        i = last(tags)
        if i and i > last(until):
            flush()
            while len(stack) > i:
                where[stack.pop().tag].pop()

    def text(piece: str) -> None:
        nonlocal linked
        if "&" in piece:
            piece = html_lib.unescape(piece)
        parts.append(piece)
        if links:
            linked += len(piece.strip())

    while at < n:
        tag_at = html.find("<", at)
        if tag_at < 0:
            text(html[at:])
            break
        if tag_at > at:
            text(html[at:tag_at])
        at = tag_at + 1
        closing = html.startswith("/", at)
        m = NAME.match(html, at + closing)
        if not m:
            if html.startswith("!--", at):
                short = next((len(x) for x in ("!-->", "!--->") if html.startswith(x, at)), 0)
                end = at + short - 1 if short else html.find("-->", at + 3)
                at = n if end < 0 else end + (1 if short else 3)
            elif closing or html.startswith(("!", "?"), at):
                end = html.find(">", at)
                at = n if end < 0 else end + 1
            else:
                text("<")
            continue
        name = m.group().lower()
        rest = ATTRIBUTES.match(html, m.end())
        at = rest.end()
        if not html.startswith(">", at):
            break  # the page ends in this tag
        at += 1
        attributes = rest.group()
        if closing:
            if name == "a":
                links = 0
            elif name in BLOCK:
                if name == "p" and not where.get("p"):
                    flush()
                close((name,), NOTHING if name in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") or name in SCOPE else SCOPE)
            continue
        if name in RAW or name in PLAIN:
            if not attributes.endswith("/") or name != "svg":
                end = ending(name).search(html, at)
                if name in PLAIN:
                    flush()
                    stack.append(Element(stack[-1], name, described(attributes), names))
                    text(html[at : end.start() if end else n])
                    flush()
                    stack.pop()
                at = end.end() if end else n
            continue
        if name in BLOCK:
            flush()
            if name in ENDS:
                close(*ENDS[name])
            if name not in ("button", "label", "option", "select") and where.get("p"):
                close(("p",), ("button", "td", "th", "table", "li") if name != "p" else ("button", "td", "th", "table"))
            if name in ("body", "main", "article"):
                close(("head",))
            where.setdefault(name, []).append(len(stack))
            stack.append(Element(stack[-1], name, described(attributes), names))
            links = 0  # an unclosed link ends with its block
        elif name == "a":
            links = 1
        elif name in ("br", "hr", "img"):
            parts.append(" ")
            if name == "hr":
                flush()
    flush()
    return out


@lru_cache(16)
def ending(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I)


@lru_cache(1 << 16)
def described(attributes: str) -> tuple[str, ...]:
    """The words of an element's classes, ids and roles, each once."""
    return tuple(dict.fromkeys(w for g in CLASS.findall(attributes) for w in TOKEN.findall("".join(g).lower()))) if attributes else ()


def word_count(text: str) -> int:
    """Words of a text: by the spaces between them; where a script has none, two letters are a word."""
    return text.count(" ") + 1 + (0 if text.isascii() else len(UNSPACED.findall(text)) // 2)


def ends(text: str) -> bool:
    """Whether a text ends as sentences do; a long one in a script that marks no end does."""
    return bool(SENTENCE.search(text)) or not text.isascii() and bool(UNSPACED.match(text[-1:])) and word_count(text) > 20


def text_features(block: Block, i: int, n: int) -> list[str]:
    text, words = block.text, word_count(block.text)
    found = [f"words={min(7, words.bit_length())}", f"linked={int(block.linked * 4)}", "bias", f"place={min(3, 4 * i // max(1, n))}"]
    if ends(text):
        found.append("ends")
    if words > 8 and ends(text):
        found.append("prose")
    if TELLING.search(text):
        found.append("telling" + ("-short" if words < 15 else ""))
    return found


class Chain:
    """Weights of a linear-chain model: features by label, label after label, first and last label."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray, ends: np.ndarray):
        self.names, self.emit, self.move, self.ends = names, emit, move, ends
        self.weight = {f: (float(emit[i, 0]), float(emit[i, 1])) for f, i in names.items()}

    def score(self, features: list[str]) -> tuple[float, float]:
        known = [self.weight[f] for f in features if f in self.weight]
        return sum(w[0] for w in known), sum(w[1] for w in known)

    def scores(self, blocks: list[Block]) -> list[tuple[float, float]]:
        out = []
        for i, b in enumerate(blocks):
            if b.at.score is None:
                b.at.score = self.score(b.at.features())
            own = self.score(text_features(b, i, len(blocks)))
            out.append((b.at.score[0] + own[0], b.at.score[1] + own[1]))
        return out

    def decode(self, blocks: list[Block]) -> list[int]:
        """Viterbi."""
        if not blocks:
            return []
        scores = self.scores(blocks)
        found = self.best(scores)
        if not any(found):
            prose = [is_prose(b) for b in blocks]
            if any(prose):
                found = self.best([(-1e9, s[1]) if p else s for s, p in zip(scores, prose, strict=True)])
        return found

    def best(self, scores: list[tuple[float, float]]) -> list[int]:
        back = []
        (a, b), (c, d) = self.move.tolist()
        x, y = scores[0][0] + self.ends[0, 0], scores[0][1] + self.ends[0, 1]
        for s in scores[1:]:
            from0, from1 = x + a < y + c, x + b < y + d
            x, y = (y + c if from0 else x + a) + s[0], (y + d if from1 else x + b) + s[1]
            back.append((int(from0), int(from1)))
        label = int(y + self.ends[1, 1] > x + self.ends[1, 0])
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def main_text(self, html: str | None) -> str:
        blocks = leaf_blocks(html or "", self.names)
        return "\n".join(b.text for b, label in zip(blocks, self.decode(blocks), strict=True) if label)


def is_prose(b: Block) -> bool:
    """Sentences, hardly any of them links, outside of what tags or classes set apart from an article."""
    return word_count(b.text) > 5 and b.linked < 0.3 and ends(b.text) and not TELLING.search(b.text) and b.at.found.isdisjoint(ASIDE)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def fit(pages: list[tuple[list[list[str]], list[int]]], steps: int = STEPS, l2: float = 3e-4) -> Chain:
    """Maximum likelihood with a little shrinkage; pages: features and label of each block."""
    names: dict[str, int] = {}
    for features, _ in pages:
        for own in features:
            for f in own:
                names.setdefault(f, len(names))
    longest, n = max(len(y) for _, y in pages), len(pages)
    of = np.array([(i * longest + t, names[f]) for i, (x, _) in enumerate(pages) for t, own in enumerate(x) for f in own])
    y, live = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (_, labels) in enumerate(pages):
        y[i, : len(labels)], live[i, : len(labels)] = labels, True
    last = live.sum(1) - 1
    weights = [np.zeros((len(names), LABELS)), np.zeros((LABELS, LABELS)), np.zeros((2, LABELS))]
    first, second = ([np.zeros_like(w) for w in weights] for _ in range(2))
    hot = np.eye(LABELS)[y] * live[..., None]
    rows = np.arange(n)
    for step in range(1, steps + 1):
        emit, move, ends = weights
        s = np.stack([np.bincount(of[:, 0], weights=emit[of[:, 1], k], minlength=n * longest) for k in range(LABELS)], -1).reshape(n, longest, LABELS)
        s[:, 0] += ends[0]
        s[rows, last] += ends[1]
        a, b = np.zeros_like(s), np.zeros_like(s)
        a[:, 0] = s[:, 0]
        for t in range(1, longest):
            a[:, t] = np.where(live[:, t, None], log_sum(a[:, t - 1, :, None] + move, 1) + s[:, t], a[:, t - 1])
        for t in range(longest - 2, -1, -1):
            b[:, t] = np.where(live[:, t + 1, None], log_sum(move + (s[:, t + 1] + b[:, t + 1])[:, None, :], 2), 0)
        total = log_sum(a[:, -1], 1)
        node = np.exp(a + b - total[:, None, None]) * live[..., None]
        edge = np.exp(a[:, :-1, :, None] + move + (s[:, 1:] + b[:, 1:])[:, :, None, :] - total[:, None, None, None]) * live[:, 1:, None, None]
        error = (node - hot) / live.sum()
        flat = error.reshape(-1, LABELS)[of[:, 0]]
        g_emit = np.stack([np.bincount(of[:, 1], weights=flat[:, k], minlength=len(names)) for k in range(LABELS)], -1)
        seen = (hot[:, :-1, :, None] * hot[:, 1:, None, :]).sum((0, 1))
        g_move = (edge.sum((0, 1)) - seen) / live.sum()
        g_ends = np.stack([error[:, 0].sum(0), error[rows, last].sum(0)])
        for w, g, m, v in zip(weights, (g_emit + l2 / 10 * emit, g_move + l2 * move, g_ends + l2 * ends), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            w -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-9)
    return Chain(names, *weights)


class Writer:
    """Makes a labelled page. Blocks carry a mark from which the label is read after parsing."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.sloppy = self.r.random() < 0.5

    def words(self, low: int, high: int) -> str:
        syllables = ("an", "ber", "ca", "de", "el", "fi", "gor", "hi", "in", "ka", "lo", "men", "no", "or", "pra", "qui", "re", "sto", "tu", "ver", "é", "ñ", "ü")
        own = ["".join(self.r.choice(syllables) for _ in range(self.r.randint(1, 4))) for _ in range(self.r.randint(low, high))]
        return " ".join(own)

    def sentence(self) -> str:
        return self.words(3, 24).capitalize() + self.r.choice((".", ".", ".", "!", "?", "", "&amp;", "..."))

    def prose(self) -> str:
        return " ".join(self.sentence() for _ in range(self.r.choice((1, 1, 2, 3, 5, 8))))

    def attribute(self, *names: str) -> str:
        name = self.r.choice(names)
        return f' {self.r.choice(("class", "class", "id"))}="{name}"' if name else ""

    def mark(self, text: str, main: bool) -> str:
        return f"{text} {MARK}{int(main)}"

    def para(self, main: bool) -> str:
        # articles too say what footers and notices say
        text = self.mark(self.r.choice(("All rights reserved.", "Released under these terms.", "Read more about it in the comments.", "Subscribe to it, and share it.")) if self.r.random() < 0.08 else self.prose(), main)
        kind = self.r.random()
        if kind < 0.15:
            text = f"<b>{text}<br>" if self.sloppy else f"<b>{text}</b>"
        elif kind < 0.3:
            text = f'<a href="/x">{self.words(1, 3)}</a> {text}'
        return f"<p>{text}" + ("" if self.sloppy and self.r.random() < 0.5 else "</p>")

    def links(self, low: int = 2, high: int = 7, text=None) -> str:
        items = [f'<a href="/{i}">{self.mark((text or (lambda: self.words(1, 3)))(), False)}</a>' for i in range(self.r.randint(low, high))]
        kind = self.r.random()
        if kind < 0.6:
            return "<ul>" + "".join(f"<li>{x}" + ("" if self.sloppy else "</li>") for x in items) + "</ul>"
        return "".join(f"<div>{x}</div>" for x in items) if kind < 0.8 else "".join(f"<p>{x}</p>" for x in items)

    def box(self, inner: str, tags: tuple[str, ...], *names: str) -> str:
        tag = self.r.choice(tags)
        return f"<{tag}{self.attribute(*names)}>{inner}</{tag}>"

    def other(self, kind: str) -> str:
        p = lambda: f"<{self.r.choice(('p', 'div', 'span'))}>{self.mark(self.prose() if self.r.random() < 0.6 else self.words(1, 12), False)}</p>"
        say = lambda *s: self.mark(self.r.choice(s) + " " + self.words(0, 6), False)
        if kind == "nav":
            return self.box(self.links(), ("nav", "nav", "div", "menu", "ul"), "", "", "menu", "nav", "navigation", "navbar", "breadcrumb", "topbar") if self.r.random() < 0.7 else f"<nav>{self.links()}</nav>"
        if kind == "header":
            return self.box(f"<{(t := self.r.choice(('div', 'p', 'h1', 'h2', 'a')))}>{self.mark(self.words(1, 5), False)}</{t}>" + (self.links() if self.r.random() < 0.5 else ""), ("header", "header", "div"), *(("header", "masthead", "banner", "site-header", "top") if self.r.random() < 0.5 else ("header", "masthead")))
        if kind == "ad":
            return self.box(self.mark(self.prose() if self.r.random() < 0.7 else self.words(2, 9), False) if self.r.random() < 0.6 else p(), ("div", "div", "aside", "section"), "ad", "ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner-ad")
        if kind == "aside":
            return self.box("".join(p() for _ in range(self.r.randint(1, 3))) + (self.links() if self.r.random() < 0.6 else ""), ("aside", "aside", "div", "section"), "sidebar", "side", "widget", "related", "rail", "recommended", "trending")
        if kind == "notice":
            return self.box(f"<p>{say('We use cookies.', 'This site uses cookies to improve your visit.', 'Please accept our terms.', 'Notice:')} {self.mark(self.prose(), False)}</p><button>{say('Accept', 'OK', 'Decline')}</button>", ("div", "div", "section", "dialog", "aside"), "cookie", "cookie-notice", "notice", "consent", "gdpr", "alert", "popup", "modal", "cookie-banner")
        if kind == "form":
            inner = f"<label>{say('Email', 'Name', 'Search', 'Subscribe')}</label><input type=text><select><option>{self.mark(self.words(1, 2), False)}<option>{self.mark(self.words(1, 2), False)}</select><button>{say('Send', 'Sign up', 'Search', 'Log in')}</button>"
            return f"<form{self.attribute('', 'newsletter', 'search', 'login', 'subscribe')}>" + (p() if self.r.random() < 0.5 else "") + inner + "</form>"
        if kind == "comments":
            own = lambda: self.box(f"<{self.r.choice(('p', 'div', 'b'))}>{say('Posted by', 'Reply by', '')}</p>{self.para(False)}", ("div", "li", "article", "p"), "comment", "comment", "reply", "comment-body")
            return self.box(f"<h3>{say('Comments', 'Discussion', 'Replies', 'Leave a reply')}</h3>" + "".join(own() for _ in range(self.r.randint(1, 5))), ("section", "div", "div", "ol", "aside"), "comments", "comments", "comment-list", "discussion", "responses", "disqus")
        if kind == "share":
            return self.box(self.links(2, 4, lambda: self.r.choice(("Share", "Tweet", "Print", "Email", "Like"))), ("div", "ul", "p"), "share", "social", "sharing", "tools", "tags", "meta")
        return self.box(f"<p>{self.mark(self.r.choice(('&copy; ', 'Copyright ', '© 2024 ', 'All rights reserved. ', '')) + self.words(1, 4) + ' &middot; ' + self.prose(), False)}</p>" if self.r.random() < 0.5 else self.mark("&copy; " + self.words(1, 4) + " &middot; " + self.prose(), False) + (self.links() if self.r.random() < 0.4 else ""), ("footer", "footer", "footer", "div"), "footer", "footer", "site-footer", "colophon", "copyright", "bottom")

    def article(self) -> str:
        body = [f"<h1>{self.mark(self.words(2, 12), True)}</h1>"] if self.r.random() < 0.85 else []
        if body and self.r.random() < 0.2:
            body = [f"<header>{body[0]}</header>"]
        for _ in range(self.r.choice((1, 2, 3, 4, 6, 9, 14))):
            kind = self.r.random()
            if kind < 0.75:
                body.append(self.para(True))
            elif kind < 0.82:
                body.append(f"<h2>{self.mark(self.words(1, 7), True)}</h2>")
            elif kind < 0.87:
                body.append("<ul>" + "".join(f"<li>{self.mark(self.prose() if self.r.random() < 0.5 else self.words(1, 6), True)}" + ("" if self.sloppy else "</li>") for _ in range(self.r.randint(2, 6))) + "</ul>")
            elif kind < 0.9:
                body.append(f"<blockquote>{self.para(True)}</blockquote>")
            elif kind < 0.92:
                body.append(f"<pre>{self.mark(self.words(2, 20), True)}</pre>")
            elif kind < 0.94:
                body.append(f"<table><tr><td>{self.mark(self.words(1, 3), True)}<td>{self.mark(self.words(1, 3), True)}</table>")
            elif kind < 0.97:
                body.append(f"<div>{self.mark(self.prose(), True)}</div>")
            else:
                body.append(self.other(self.r.choice(("ad", "ad", "share", "aside", "form", "notice"))))
        if self.r.random() < 0.15:
            body.append(self.other("share"))
        if self.r.random() < 0.15:
            body.append(self.other("comments"))
        inner, kind = "".join(body), self.r.random()
        if kind < 0.55:
            return f"<article{self.attribute('', '', '', 'post', 'entry', 'story')}>{inner}</article>"
        if kind < 0.75:
            return f"<main{self.attribute('', '', 'main', 'content')}>" + (f"<article>{inner}</article>" if self.r.random() < 0.4 else inner) + "</main>"
        return f"<div{self.attribute('content', 'article', 'post', 'entry-content', 'main', 'main-content', 'article-body', 'story', 'post-body')}>{inner}</div>"

    def page(self) -> str:
        before = [k for k, p in (("notice", 0.15), ("header", 0.4), ("nav", 0.75), ("ad", 0.5), ("form", 0.1), ("aside", 0.15)) if self.r.random() < p]
        after = [k for k, p in (("share", 0.1), ("ad", 0.25), ("form", 0.15), ("comments", 0.3), ("aside", 0.3), ("nav", 0.1), ("footer", 0.85), ("notice", 0.15)) if self.r.random() < p]
        if self.r.random() < 0.4:
            self.r.shuffle(before)
        title = self.mark(self.words(2, 9), False)
        head = f"<head><title>{title}</title></head>"
        body = "".join(map(self.other, before)) + self.article() + "".join(map(self.other, after))
        if self.r.random() < 0.3:
            body = f"<div{self.attribute('wrapper', 'page', 'container', 'site')}>{body}</div>"
        return f"<!DOCTYPE html><html>{head}<body>{body}" + ("" if self.sloppy else "</body></html>")


    def slot(self, kind: str) -> str:
        """What stands in a slot of a layout (html_layouts.py)."""
        r, main = self.r, lambda text: self.mark(text, True)
        end = "" if self.sloppy else "</p>"
        if kind in "Hh":
            return f"<h{1 if kind == 'H' else r.choice((2, 3))}>{main(self.words(1, 9))}</h{1 if kind == 'H' else 2}>"
        if kind == "P":
            return "".join(self.para(True) for _ in range(r.choice((1, 2, 3, 5))))
        if kind == "T":
            return main(self.prose())
        if kind == "S":
            return main(self.words(2, 10))
        if kind == "B":
            return "<ul>" + "".join(f"<li>{main(self.prose() if r.random() < 0.5 else self.words(1, 8))}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        if kind == "Q":
            return f"<blockquote><p>{main(self.prose())}{end}</blockquote>"
        if kind == "C":
            return main(self.words(4, 40))
        if kind == "X":
            return "<table>" + "".join(f"<tr><td>{main(self.words(1, 3))}</td><td>{main(self.words(1, 6))}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>"
        if kind == "n":
            return self.links()
        if kind == "i":
            return r.choice((" | ", " ", " &middot; ")).join(f'<a href="/{i}">{self.mark(self.words(1, 3), False)}</a>' for i in range(r.randint(2, 6)))
        if kind == "t":
            return self.mark(self.words(1, 6), False)
        if kind == "p":
            return f"<p>{self.mark(self.prose(), False)}{end}"
        if kind == "f":
            return self.other("form")
        if kind == "k":
            return f"<p>{self.mark(r.choice(('We use cookies. ', 'This site uses cookies. ', 'Please accept our terms. ')) + self.prose(), False)}</p><button>{self.mark('OK', False)}</button>"
        if kind == "d":
            return "".join(f"<div class=comment><b>{self.mark(self.words(1, 3), False)}</b>{self.para(False)}</div>" for _ in range(r.randint(1, 4)))
        return f"<p>{self.mark(r.choice(('&copy; ', 'Copyright ', '', 'All rights reserved. ')) + self.words(1, 8), False)}{end}"

    def laid_out(self, layout: str) -> str:
        """A page of a layout; now and then without its classes and ids, so that tags and texts must tell."""
        if self.r.random() < 0.35:
            layout = re.sub(r" (?:class|id|role)=(?:\"[^\"]*\"|\w+)", "", layout)
        return re.sub(r"\{(\w)\}", lambda m: self.slot(m[1]), layout)


def labelled_pages(n: int, seed: int = 0) -> list[tuple[list[Block], list[int]]]:
    """Blocks and labels of n made pages."""
    out = []
    for i in range(n):
        blocks, labels = [], []
        writer = Writer(seed * 1_000_003 + i)
        for b in leaf_blocks(writer.page() if i % 2 else writer.laid_out(LAYOUTS[i // 2 % len(LAYOUTS)])):
            marks = re.findall(f"{MARK}([01])", b.text)
            text = " ".join(re.sub(f"{MARK}[01]", "", b.text).split())
            if text and marks:
                blocks.append(b._replace(text=text))
                labels.append(int(marks[0]))
        out.append((blocks, labels))
    return out


@lru_cache(4)
def trained(pages: int = PAGES, seed: int = 0) -> Chain:
    made = [(b, y) for b, y in labelled_pages(pages, seed) if b]
    return fit([([b.at.features() + text_features(b, i, len(bs)) for i, b in enumerate(bs)], y) for bs, y in made])


def extracted(chain: Chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [chain.main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: a row for each of pages (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(extracted(trained()), "page_id long, url string, text string, n_chars long")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
