"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text between block-level tags, each with its path of ancestors. Scripts,
styles, markup and form controls never become blocks. Features of ancestor tags, of their class and id names, and
of the text itself give node scores for keep and drop; neighbouring blocks share transition scores; Viterbi finds
the best labelling. The field is trained here, by gradient ascent on the conditional likelihood, on labelled pages
that a seeded generator lays out in many ways.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Labelled pages to train on, and steps of ascent.
TRAINING_PAGES = 500
STEPS = 150
_SEED = 7

_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table caption thead tbody tfoot tr td th ul".split()
)
#: Elements whose content is never text of the page.
_SILENT = frozenset("script style noscript template svg math iframe object canvas audio video textarea select option datalist title button".split())
#: Silent elements that authors leave open: they also end where an element around them does, and, where no end tag
#: follows at all, at the next block.
_LOOSE = frozenset("button select option datalist".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the key ends where one of the values begins.
_CLOSED_BY = {"p": _BLOCKS - {"html", "head", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
_SCOPES = frozenset("ul ol dl table article section div body main aside nav footer header blockquote form".split())
#: A quote opens a value only after an equals sign; elsewhere it is a character like any other.
_TAG = re.compile(
    r"<(?:!--(?P<c>.*?)(?:-->|\Z)|(?P<d>[!?][^>]*+)(?:>|\Z)|(?P<e>/?)(?P<n>[A-Za-z][^\s/>\x00]*+)"
    r"(?P<a>(?:[^>=]|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?)*+)(?:>|\Z))",
    re.S,
)
_ATTR = re.compile(r"(?<![^\s\"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(slots=True)
class Block:
    text: str
    tags: tuple[str, ...]
    names: tuple[str, ...]
    linked: int
    bold: int


@dataclass(slots=True)
class _Open:
    tag: str
    names: tuple[str, ...]


def _attributes(source: str) -> tuple[tuple[str, ...], bool]:
    """Words of class, id and role; whether the element is hidden."""
    names, hidden = [], False
    for k, a, b, c in _ATTR.findall(source):
        k, v = k.lower(), a or b or c
        if k == "hidden" or k == "aria-hidden" and v == "true":
            hidden = True
        elif k != "aria-hidden":
            names += [w.lower() for w in _NAMES.findall(v)]
    return tuple(names), hidden


def blocks(source: str) -> list[Block]:
    """Leaf blocks in page order. Character references are decoded, white space is one blank, empty blocks go."""
    out: list[Block] = []
    stack: list[_Open] = []
    parts: list[str] = []
    linked = bold = in_link = in_bold = 0
    silent: str | None = None
    depth = at = 0
    unended: set[str] = set()  # tags without an end tag in the rest of the page

    def flush() -> None:
        nonlocal linked, bold
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, tuple(o.tag for o in stack), tuple(n for o in stack for n in o.names), min(linked, len(text)), min(bold, len(text))))
        parts.clear()
        linked = bold = 0

    def add(text: str) -> None:
        nonlocal linked, bold
        if silent is None and text:
            parts.append(text)
            linked += len(text) if in_link else 0
            bold += len(text) if in_bold else 0

    n = len(source)
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            add(source[at:])
            break
        add(source[at:lt])
        m = _TAG.match(source, lt)
        if not m:
            add("<")
            at = lt + 1
            continue
        at = m.end()
        if not m["n"]:
            continue
        tag, closing = m["n"].lower(), bool(m["e"])
        if silent is not None:
            if tag == silent:
                depth += -1 if closing else silent not in _LOOSE  # these do not nest
                if depth == 0:
                    silent = None
                continue
            if silent not in _LOOSE or tag not in _BLOCKS or not (silent in unended or closing and any(o.tag == tag for o in stack)):
                continue
            silent = None
        if not closing and tag in _SILENT:
            if tag in ("script", "style", "textarea", "title", "noscript", "iframe"):  # their content is no markup
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = end.end() if end else n
            elif not m["a"].rstrip().endswith("/"):
                silent, depth = tag, 1
                if tag in _LOOSE and tag not in unended and not re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at):
                    unended.add(tag)
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        elif tag in ("b", "strong"):
            in_bold = 0 if closing else 1
        if tag == "br":
            add(" ")
        elif tag in _BLOCKS:
            flush()
            in_bold = 0
            if closing:
                k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag), None)
                if k is not None:
                    del stack[k:]
                    in_link = 0
            elif tag not in _VOID:
                k = len(stack) - 1
                while k >= 0 and stack[k].tag not in _SCOPES:
                    if tag in _CLOSED_BY.get(stack[k].tag, ()):
                        del stack[k:]
                    k -= 1
                names, hidden = _attributes(m["a"])
                if hidden:
                    names += ("hidden",)
                stack.append(_Open(tag, names))
    flush()
    return out


# -- features -----------------------------------------------------------------------------------------------

_SIDE = ("nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset", "head")
_MAIN = ("article", "main")
_LEAF = ("p", "h1", "h2", "h3", "h4", "li", "td", "th", "pre", "blockquote", "figcaption", "dt", "dd", "div", "section", "legend", "summary")
#: Words in class, id and role names, by what they speak of.
_WORDS = {
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs crumbs tabs toolbar pagination pager skip topbar navi",
    "head": "header masthead banner head top logo",
    "foot": "footer foot bottom copyright legal contentinfo colophon imprint",
    "side": "sidebar side aside widget widgets related recommended recommend more popular trending rail complementary teaser teasers promo",
    "note": "cookie cookies consent notice notices alert gdpr banner popup modal overlay newsletter subscribe subscription paywall message disclaimer warning",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promotion promoted commercial dfp adsense",
    "form": "form search login signup signin register contact feedback poll",
    "comment": "comment comments disqus respond reply replies discussion reader readers commentlist reviews",
    "share": "share sharing social tags tag meta byline author date toolbar buttons print",
    "main": "article content main post entry story body text page prose maincontent articlebody",
    "hidden": "hidden invisible",
}
_CLASS_OF = {w: k for k, (_, ws) in enumerate(_WORDS.items()) for w in ws.split()}
_PHRASES = re.compile(r"cookie|copyright|©|all rights reserved|advertis|sponsor|subscribe|sign up|log ?in|read more|share (?:this|on)|comment|reply|newsletter|privacy|terms of|posted by|related|menu|search", re.I)
_NUMBERS = re.compile(r"\d+")
N_FEATURES = 1 + 2 * len(_WORDS) + len(_SIDE) + len(_MAIN) + len(_LEAF) + 14


def features(bs: list[Block]) -> np.ndarray:
    x = np.zeros((len(bs), N_FEATURES), np.float32)
    article_there = any(t in _MAIN for b in bs for t in b.tags)
    for k, b in enumerate(bs):
        r = x[k]
        r[0] = 1
        at = 1
        last = len(b.names) - 4
        for j, w in enumerate(b.names):
            c = _CLASS_OF.get(w)
            if c is not None:
                r[at + c] = 1
                if j >= last:
                    r[at + len(_WORDS) + c] = 1
        at += 2 * len(_WORDS)
        tags = set(b.tags)
        for j, t in enumerate(_SIDE):
            r[at + j] = t in tags
        at += len(_SIDE)
        for j, t in enumerate(_MAIN):
            r[at + j] = t in tags
        at += len(_MAIN)
        leaf = b.tags[-1] if b.tags else ""
        for j, t in enumerate(_LEAF):
            r[at + j] = t == leaf
        at += len(_LEAF)
        n, words = len(b.text), b.text.count(" ") + 1
        link = b.linked / n
        r[at : at + 14] = (
            min(words, 60) / 60, words < 4, words > 15, link, link > 0.5, b.bold / n > 0.9, b.text[-1] in ".!?:;\"'»”…", min(b.text.count(". ") + b.text.count(", "), 10) / 10,
            min(20 * len(_PHRASES.findall(b.text)) / words, 1), min(5 * len(_NUMBERS.findall(b.text)) / words, 1), article_there and not (tags & set(_MAIN)), not article_there, not b.tags, "©" in b.text or "·" in b.text,
        )
    return x


# -- the field ------------------------------------------------------------------------------------------------


class Field:
    """Weights of drop (0) and keep (1) per feature, transitions, and scores of the first block's label."""

    def __init__(self, node: np.ndarray, step: np.ndarray, first: np.ndarray) -> None:
        self.node, self.step, self.first = node, step, first

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        if not n:
            return np.zeros(0, int)
        s = x @ self.node
        best = (s[0] + self.first).tolist()
        (t00, t01), (t10, t11) = self.step.tolist()
        back: list[tuple[int, int]] = []
        for a, b in s[1:].tolist():
            c0, c1 = best[0] + t00, best[1] + t10
            d0, d1 = best[0] + t01, best[1] + t11
            back.append((int(c1 > c0), int(d1 > d0)))
            best = [a + max(c0, c1), b + max(d0, d1)]
        out = np.empty(n, int)
        out[-1] = best[1] > best[0]
        for k in range(n - 2, -1, -1):
            out[k] = back[k][out[k + 1]]
        return out


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (np.log(np.exp(a - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def train(pages: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS) -> Field:
    """Conditional likelihood by gradient ascent with momentum; pages are padded to run side by side."""
    top, d = max(len(y) for _, y in pages), pages[0][0].shape[1]
    x = np.zeros((len(pages), top, d))
    y = np.zeros((len(pages), top), int)
    size = np.array([len(v) for _, v in pages])
    for k, (a, b) in enumerate(pages):
        x[k, : len(b)], y[k, : len(b)] = a, b
    there = np.arange(top)[None, :] < size[:, None]
    flat = x[there]
    rows = np.arange(len(pages))
    node, step, first = np.zeros((d, 2)), np.zeros((2, 2)), np.zeros(2)
    speed = [np.zeros_like(node), np.zeros_like(step), np.zeros_like(first)]
    want = np.eye(2)[y]
    seen = np.zeros((2, 2))
    both = there[:, 1:]
    np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
    for _ in range(steps):
        s = np.zeros((len(pages), top, 2))
        s[there] = flat @ node
        fwd, bwd = np.empty_like(s), np.zeros_like(s)
        fwd[:, 0] = s[:, 0] + first
        for k in range(1, top):
            fwd[:, k] = np.where(there[:, k, None], s[:, k] + _log_sum(fwd[:, k - 1, :, None] + step, 1), fwd[:, k - 1])
        for k in range(top - 2, -1, -1):
            bwd[:, k] = np.where(there[:, k + 1, None], _log_sum(step[None] + (s[:, k + 1] + bwd[:, k + 1])[:, None, :], 2), 0.0)
        z = _log_sum(fwd[rows, size - 1], 1)
        p = np.exp(fwd + bwd - z[:, None, None])
        pair = np.exp(fwd[:, :-1, :, None] + step + (s[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None])[both].sum(axis=0)
        n = there.sum()
        grads = [flat.T @ (want[there] - p[there]) / n - 1e-4 * node, (seen - pair) / n - 1e-4 * step, (want[:, 0] - p[:, 0]).sum(axis=0) / len(pages) * 0.05]
        for w, v, g in zip((node, step, first), speed, grads):
            v *= 0.9
            v += 0.8 * g
            w += v
    return Field(node, step, first)


# -- labelled pages -------------------------------------------------------------------------------------------


def labelled_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page laid out at random, and the texts of its main blocks in order."""
    syl = ["ta", "en", "ri", "lo", "mas", "ver", "chi", "don", "que", "al", "ist", "or"]
    word = lambda: "".join(rng.choice(syl) for _ in range(rng.randint(1, 4)))
    say = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b))).capitalize() + rng.choice([".", ".", ".", "", "!"])
    long = lambda: " ".join(say(3, 14) for _ in range(rng.randint(1, 6)))
    pick = rng.choice
    keep: list[str] = []

    def named(tag: str, *names: str) -> tuple[str, str]:
        """An element that says what it is by its tag, its class or its id."""
        form = rng.random()
        if tag not in ("div", "section") and form < 0.45:
            return f"<{tag}>", f"</{tag}>"
        if form < 0.8:
            return f'<{pick([tag, "div"])} class="{pick(["", "c1 ", "x-"])}{pick(names)}">', "</div>"
        return f'<div {pick(["id", "class"])}="{pick(names)}{pick(["", "-wrap", "-box", "_1"])}">', "</div>"

    def wrap(opened: tuple[str, str], inner: str) -> str:
        a, b = opened
        tag = re.match(r"<(\w+)", a)[1]
        return f"{a}{inner}</{tag}>"

    links = lambda n: "<ul>" + "".join(f'<li><a href="/{word()}">{" ".join(word() for _ in range(rng.randint(1, 3)))}</a></li>' for _ in range(n)) + "</ul>"
    inline_links = lambda n: pick([" | ", " "]).join(f'<a href="/{word()}">{word()}</a>' for _ in range(n))
    paras = lambda n: "".join(f"<p>{say(3, 20)}</p>" for _ in range(n))

    menu = lambda: wrap(named("nav", "nav", "menu", "navbar", "breadcrumbs", "topnav"), pick([links, inline_links])(rng.randint(3, 8)))
    head = lambda: wrap(named("header", "header", "masthead", "site-header", "top-banner"), pick([f"<a href='/'>{word()}</a>", f"<h1>{say(1, 3)}</h1><p>{say(2, 6)}</p>", f"<div>{say(1, 5)}</div>"]) + (menu() if rng.random() < 0.3 else ""))
    foot = lambda: wrap(named("footer", "footer", "site-footer", "copyright", "legal"), pick([f"&copy; {rng.randint(1990, 2030)} {word()}", f"&copy; {word()}.example &middot; {say(2, 9)}", paras(1), f"<p>{say(2, 8)}</p>{links(3)}"]))
    side = lambda: wrap(named("aside", "sidebar", "related", "widget", "recommended", "popular-posts"), f"<h3>{say(1, 3)}</h3>" + pick([links(rng.randint(2, 6)), paras(rng.randint(1, 3))]))
    note = lambda: wrap(named("div", "cookie-notice", "notice", "consent", "newsletter", "alert", "gdpr-banner", "paywall"), pick([f"<p>{say(5, 20)}</p>", say(4, 16), f"<p>We use cookies. {say(3, 9)}</p><button>OK</button>"]))
    advert = lambda: wrap(named("div", "ad", "ads", "advert", "sponsored", "promo", "ad-slot", "advertisement"), pick([say(3, 14), f"<p>{say(3, 14)}</p>", f'<a href="/{word()}">{say(2, 8)}</a>']))
    form = lambda: f'<form{pick(["", f" class={pick(["search", "login", "contact"])}"])}>' + pick([f"<label>{word()}</label><input name=q>", f"<p>{say(2, 6)}</p><label>{word()}</label><textarea>{word()}</textarea>", f"<div>{say(1, 4)}</div><select><option>{word()}</option></select>"]) + "<button>Go</button></form>"
    comments = lambda: wrap(named("section", "comments", "comment-list", "disqus", "reader-comments", "responses-discussion"), f"<h3>{pick(['Comments', say(1, 2)])}</h3>" + "".join(pick([f'<div class="comment"><b>{word()}</b><p>{long()}</p></div>', f"<li>{long()}</li>", f"<p>{long()}</p>"]) for _ in range(rng.randint(1, 4))))
    share = lambda: f'<div class="{pick(["share", "social", "tags"])}">{inline_links(3)}</div>'

    stock = ["All rights reserved.", "Released under the licence of the author.", "Read more about it below.", "See the comments policy.", "Subscribe to the newsletter.", "Copyright of the author.", "Search and privacy."]

    def body_block() -> str:
        t = pick(stock) if rng.random() < 0.08 else long()
        keep.append(t)
        r = rng.random()
        if r < 0.08:
            cut = t.find(" ") + 1
            return f"<p>{t[:cut]}<a href='/{word()}'>{t[cut:cut + 12]}</a>{t[cut + 12:]}</p>"
        if r < 0.5:
            return f"<p>{t}</p>"
        if r < 0.62:
            return f"<p><b>{t}<br>"
        if r < 0.72:
            return f"<p>{t}"
        if r < 0.8:
            return f"<blockquote>{t}</blockquote>"
        if r < 0.86:
            return f"<pre>{t}</pre>"
        if r < 0.93:
            return f"<div>{t}</div>"
        items = [say(2, 9) for _ in range(rng.randint(2, 5))]
        keep.pop()
        keep.extend(items)
        row = pick([("<ul>", "<li>", "</li>", "</ul>"), ("<table>", "<tr><td>", "</td></tr>", "</table>")])
        return row[0] + "".join(row[1] + i + row[2] for i in items) + row[3]

    def main() -> str:
        inner = ""
        if rng.random() < 0.8:
            t = say(2, 14)
            keep.append(t)
            inner += f"<h1>{t}</h1>" if rng.random() < 0.8 else f"<h2>{t}</h2>"
        for _ in range(rng.randint(1, 9)):
            if rng.random() < 0.12:
                t = say(1, 5) if rng.random() < 0.9 else pick(stock)
                keep.append(t)
                inner += f"<h2>{t}</h2>"
            inner += body_block()
            if rng.random() < 0.08:
                inner += pick([advert, side, note, share, form])()
        if rng.random() < 0.1:
            inner += comments()
        a = pick(["<article>", "<article>", "<main>", '<div class="content">', '<div id="main-content">', '<div class="post-body">', '<section class="article">', "<main><article>", '<div class="entry">', "<div>"])
        return a + inner + "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", a)))

    before = [f() for f in (head, menu, note, advert, side, form) if rng.random() < 0.45]
    after = [f() for f in (comments, side, share, advert, form, note, foot) if rng.random() < 0.45]
    rng.shuffle(before)
    page = "".join(["<!DOCTYPE html><html><head><title>", say(1, 5), "</title><style>p{}</style></head><body>", *before, main(), *after, "</body></html>"])
    return page, keep


@cache
def trained(pages: int = TRAINING_PAGES) -> Field:
    rng, data = random.Random(_SEED), []
    for _ in range(pages):
        page, keep = labelled_page(rng)
        bs, want, y = blocks(page), [" ".join(t.split()) for t in keep], []
        k = 0
        for b in bs:
            hit = k < len(want) and b.text == want[k]
            y.append(int(hit))
            k += hit
        if bs and k == len(want):
            data.append((features(bs), np.array(y)))
    return train(data)


def main_text(source: str | None, field: Field) -> str:
    bs = blocks(source or "")
    keep = field.viterbi(features(bs))
    return " ".join(b.text for b, k in zip(bs, keep) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per page, without a shuffle.

    Null and empty html give an empty text, as do pages without main blocks; repeated rows are read each; other
    columns are not looked at.
    """
    ship(pages.sparkSession)
    field = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(t, field) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return src.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
