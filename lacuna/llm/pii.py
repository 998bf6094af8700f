"""Personal data by patterns and a skip-chain conditional random field.

Patterns find the base spans. The field labels every token that holds a digit or an at sign (all others can only be
outside). Its nodes look at the token and the words before it; tokens that follow one another on a line share chain
potentials, of one kind where they stand side by side and of another where words stand between; tokens of a document
that repeat, or are written alike, share skip potentials however far apart they stand. Tokens inside base spans are
observed; loopy sum-product messages then carry their labels to other mentions of the same thing, and to the parts of
numbers that run into one another, which the patterns miss. The field only adds spans.

It is trained here on generated documents. All weights are learned together: the pseudo-likelihood, every label's
probability given its neighbours' true labels, is climbed by gradient.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

KINDS = ("email", "ip", "card", "phone")
#: Least marginal probability of every token of an added span.
SURE = 0.9
#: Messages that change by less have settled; loops that never settle end after so many rounds.
TOLERANCE, ROUNDS = 1e-6, 1_000
#: Generated training documents; the bound on what is learned from.
TRAINING = 600
STEPS = 300
#: Tokens that go into one graph; texts are added whole, up to this number.
GRAPH_TOKENS = 50_000
#: Farthest that two tokens of a line share a chain potential, in characters.
REACH = 60
_SEED = 20_240_117

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\S*[0-9@]\S*")
_EDGE_FRONT, _EDGE_BACK = "\"'<>[]{},;:!?.=*", "\"'<>[]{},;:!?.=*"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each at sign ends one run of local characters, so that every match is found from its at sign."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number), by start, then kind."""
    out = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def tokens(text: str) -> list[tuple[int, int]]:
    """Spans of the tokens with a digit or at sign, without the marks around them."""
    out = []
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        t = m.group()
        a += len(t) - len(t.lstrip(_EDGE_FRONT))
        b -= len(t) - len(t.rstrip(_EDGE_BACK))
        if text[a:a + 1] == "(" and ")" not in text[a:b]:
            a += 1
        if text[b - 1:b] == ")" and "(" not in text[a:b]:
            b -= 1
        if b > a:
            out.append((a, b))
    return out


_SHAPES = tuple(
    re.compile(p)
    for p in (
        r"[^@]+@[^@]+", r"[^@]+@[^@]*\w\.\w[^@]*", r"[0-9]+", r"\+[0-9(].*", r".*[()].*", r"[0-9]+(?:-[0-9]+)+", r"[0-9]+(?:\.[0-9]+)+", r"[0-9]+(?:/[0-9]+)+",
        r"[0-9]{1,3}(?:[^0-9A-Za-z]{1,3}[0-9]{1,3}){3}", r"(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}", r"[0-9]{1,2}[-./][0-9]{1,2}[-./](?:19|20)?[0-9]{2}",
        r"[0-9]+[.,][0-9]{1,2}", r".*[A-Za-z].*", r"[0-9a-fA-F]{12,}", r"00[0-9]+", r"\$.*|.*%", r"[0-9]{1,2}:[0-9]{2}.*", r"[0-9]{4}", r"v?[0-9]+\.[0-9]+\.[0-9]+",
    )
)


#: Words before a number that tell what it is, by label, and words before numbers of no one.
_CUES = (
    "mail email write contact correo courriel", "ip host server address ping node gateway client router", "card visa mastercard amex credit debit karte kreditkarte carte tarjeta",
    "phone telephone tel call mobile cell fax dial ring telefon handy mobil appelez telephone telefono llame movil", "order invoice ticket item no number page version sku ref reference isbn id code part lot batch room total price year bestellung commande pedido",
)
_CUE_OF = {w: k for k, ws in enumerate(_CUES) for w in ws.split()}
_WORD = re.compile(r"[a-z]+")


def features(token: str, before: str = "") -> list[float]:
    """Shape and digits of a token, and what the last two words of ``before`` say it is."""
    digits = "".join(_DIGITS.findall(token))
    n = len(digits)
    parts = [p for p in re.split(r"[^0-9]+", token) if p]
    quad = len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    out = [1.0, *(float(p.fullmatch(token) is not None) for p in _SHAPES)]
    out += [float(n == 0), float(0 < n < 4), float(4 <= n < 7), float(7 <= n < 10), float(10 <= n < 13), float(13 <= n < 20), float(n > 19)]
    out += [float(13 <= n <= 19 and luhn(digits)), float(quad), float(len(parts) == 4 and not quad), float(len(token) > 24)]
    cues = {_CUE_OF.get(w) for w in _WORD.findall(before.lower())[-2:]}
    return out + [float(k in cues) for k in range(len(_CUES))]


def shared_form(token: str) -> str | None:
    """Tokens of the same form count as repeated or similar: mail addresses up to the first dot of their domain, without
    case; four numbers up to 255; else the last seven digits, where there are four or more."""
    if "@" in token:
        name, _, domain = token.lower().partition("@")
        return f"{name}@{domain.partition('.')[0]}"
    parts = [p for p in re.split(r"[^0-9]+", token) if p]
    if len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts):
        return ".".join(str(int(p)) for p in parts)
    digits = "".join(parts)
    return digits[-7:] if len(digits) >= 4 else None


BESIDE, APART, SKIP = range(3)


def graph(text: str, toks: list[tuple[int, int]], base: list[tuple[int, int, int]] = ()) -> list[tuple[int, int, int]]:
    """Edges (token, token, kind). Each token is joined to the one before it on its line, and, by its form, to the first
    token of that form, so that all mentions are two edges apart at most. The last token of a base span also has the
    form of the whole span."""
    edges, first, j = [], {}, 0
    for k, (a, b) in enumerate(toks):
        if k:
            gap = text[toks[k - 1][1] : a]
            if len(gap) <= REACH and "\n" not in gap:
                edges.append((k - 1, k, BESIDE if len(gap) <= 1 else APART))
        while j < len(base) and base[j][1] < a:
            j += 1
        forms = {shared_form(text[a:b])}
        if j < len(base) and base[j][1] <= b and base[j][0] < a:
            forms.add(shared_form(text[base[j][0] : base[j][1]]))
        for form in sorted(forms - {None}):
            hub = first.setdefault(form, k)
            if hub < k:
                edges.append((hub, k, SKIP))
    return edges


class SkipChain:
    """Weights of the field: nodes (features x labels), and one matrix (labels x labels) for each kind of edge."""

    def __init__(self, node: np.ndarray, *pairs: np.ndarray) -> None:
        self.node, self.pairs = node, list(pairs)

    def marginals(self, x: np.ndarray, seen: np.ndarray, edges: list[tuple[int, int, int]], part: np.ndarray | None = None) -> np.ndarray:
        """Node marginals by loopy sum-product; ``seen`` holds observed labels, -1 where none; no edge joins nodes of
        different ``part``. Messages pass in each part until they settle."""
        score = x @ self.node
        fixed = np.flatnonzero(seen >= 0)
        score[fixed] = -1e6  # more than any number of messages
        score[fixed, seen[fixed]] = 1e6
        ends = np.array(edges, np.int64).reshape(-1, 3)
        part = np.zeros(len(score), np.int64) if part is None else part
        weight = np.exp(np.stack([*self.pairs, *(p.T for p in self.pairs)]))
        n = len(ends)
        src, dst, kind = np.r_[ends[:, 0], ends[:, 1]], np.r_[ends[:, 1], ends[:, 0]], np.r_[ends[:, 2], ends[:, 2] + len(self.pairs)]
        back = np.r_[np.arange(n, 2 * n), np.arange(n)]
        msg = np.zeros((2 * n, 5))
        for _ in range(ROUNDS):
            if not len(src):
                break
            belief = score.copy()
            np.add.at(belief, dst, msg)
            out = belief[src] - msg[back]
            top = out.max(axis=1, keepdims=True)
            out = np.exp(out - top)
            new = np.empty_like(msg)
            for k in range(len(weight)):
                of = kind == k
                new[of] = out[of] @ weight[k]
            new = np.log(new)
            new -= new.max(axis=1, keepdims=True)
            moved = np.zeros(part.max() + 1)
            np.maximum.at(moved, part[dst], np.abs(new - msg).max(axis=1))
            msg = 0.5 * msg + 0.5 * new
            live = moved[part[dst]] >= TOLERANCE
            if not live.all():  # settled parts leave, their messages stay
                np.add.at(score, dst[~live], msg[~live])
                number = np.cumsum(live) - 1
                back = number[back[live]]
                src, dst, kind, msg = src[live], dst[live], kind[live], msg[live]
        if len(src):
            np.add.at(score, dst, msg)
        p = np.exp(score - score.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


# -- generated documents ----------------------------------------------------------------------------------------


def labelled_document(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A generated document and its labelled spans. Things come in a form that the patterns know and then, far off, in
    forms that they do not know; numbers of no one look the same. Some things run into the next without a word."""
    syl = ["ba", "den", "lor", "mi", "tas", "ven", "quo", "rik", "sum", "ter", "ali", "nor"]
    word = lambda: "".join(rng.choice(syl) for _ in range(rng.randint(1, 3)))
    num = lambda n: "".join(str(rng.randint(0, 9)) for _ in range(n))

    def email() -> list[str]:
        name, host = f"{word()}{rng.choice(['.', '_', ''])}{word()}{num(rng.randint(0, 2))}", word()
        full = f"{name}@{host}{rng.choice(['.com', '.org', '.example', '.co.uk'])}"
        return [full, full.upper(), f"{name}@{host}"]

    def address() -> list[str]:
        q = [str(rng.randint(0, 255)) for _ in range(4)]
        return [".".join(q), "-".join(q), "_".join(q), "[" + ":".join(q) + "]"]

    def card() -> list[str]:
        d = str(rng.choice([3, 4, 5, 6])) + num(rng.choice([14, 14, 14, 13]))
        d += next(c for c in "0123456789" if luhn(d + c))
        cut = lambda sep: sep.join(d[k : k + 4] for k in range(0, len(d), 4))
        return [rng.choice([d, cut(" "), cut("-")]), cut("."), cut("_"), cut("/"), d]

    def phone() -> list[str]:
        country, area, a, b = rng.choice(["1", "44", "49", "33", "34"]), num(3), num(3), num(4)
        full = rng.choice([f"+{country} ({area}) {a}-{b}", f"+{country} {area} {a}{b}", f"+{country}-{area}-{a}-{b}", f"+{country}{area}{a}{b}"])
        return [full, f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"{area}{a}{b}", f"00{country}{area}{a}{b}", f"{area}.{a}.{b}"]

    decoy = [
        lambda: num(rng.randint(1, 6)), lambda: f"{rng.randint(1900, 2040)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1900, 2040)}",
        lambda: f"{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}", lambda: f"${num(3)}.{num(2)}", lambda: f"{num(2)}%", lambda: f"{rng.randint(0, 23)}:{rng.randint(0, 59):02}", lambda: f"{num(2)}.{num(1)}",
        lambda: hashlib.sha1(num(9).encode()).hexdigest()[: rng.choice([16, 20, 32, 40])], lambda: num(rng.randint(7, 13)), lambda: num(10), lambda: num(rng.randint(14, 24)), lambda: f"{word()}{num(3)}", lambda: f"@{word()}",
        lambda: f"{num(4)}/{num(5)}", lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: ".".join(num(3) for _ in range(rng.choice([3, 4, 5, 6]))), lambda: "-".join(str(rng.randint(0, 255)) for _ in range(4)), lambda: f"{num(3)}.{num(3)}.{num(4)}", lambda: f"{word()}@{word()}",
    ]
    things = [(k, (email, address, card, phone)[k]()) for k in rng.choices(range(4), k=rng.randint(0, 4))]
    told = [(k, forms, n) for k, forms in things for n in [0] * (rng.random() < 0.75) + [1] * rng.randint(0, 3)]
    parts: list[tuple[str, int]] = []
    order = rng.sample(range(len(told)), len(told))
    if rng.random() < 0.7:
        order.sort(key=lambda i: told[i][2])
    for i in order:
        k, forms, n = told[i]
        for _ in range(rng.choice([0, 1, 2, 6])):
            if rng.random() < 0.3:
                if rng.random() < 0.4:
                    parts.append((rng.choice(_CUES[4].split()), -1))
                parts.append((rng.choice(decoy)(), -1))
            else:
                parts += [(word(), -1)] * rng.randint(1, 4)
        if rng.random() < 0.4:
            parts.append((rng.choice(_CUES[k].split()), -1))
        parts.append((forms[0] if n == 0 else rng.choice(forms[1:]), k))
    for _ in range(rng.randint(0, 6)):
        parts += [(word(), -1)] * rng.randint(1, 3) + [(rng.choice(decoy)(), -1)]
    text, spans = "", []
    for t, k in parts:
        if k >= 0:
            spans.append((len(text), len(text) + len(t), k))
        text += t + rng.choice([" ", " ", " ", " ", ", ", ". ", "\n"])
    return text, spans


@cache
def trained(size: int = TRAINING) -> SkipChain:
    """Deterministic; a few seconds."""
    rng = random.Random(_SEED)
    xs, ys, edges = [], [], []
    for _ in range(size):
        text, spans = labelled_document(rng)
        toks = tokens(text)
        edges += [(a + len(ys), b + len(ys), kind) for a, b, kind in graph(text, toks, base_spans(text))]
        xs += node_features(text, toks)
        ys += [next((k + 1 for a, b, k in spans if a < tb and ta < b), 0) for ta, tb in toks]
    x, target, e = np.array(xs), np.eye(5)[ys], np.array(edges, np.int64)
    beside = []  # labels of the neighbours before and after each node, summed, for each kind of edge
    for kind in range(3):
        a, b = e[e[:, 2] == kind, 0], e[e[:, 2] == kind, 1]
        before, after = np.zeros_like(target), np.zeros_like(target)
        np.add.at(before, b, target[a])
        np.add.at(after, a, target[b])
        beside.append((before, after))
    weights = [np.zeros((x.shape[1], 5)), *(np.zeros((5, 5)) for _ in range(3))]
    speed = [np.zeros_like(w) for w in weights]
    for _ in range(STEPS):
        s = x @ weights[0] + sum(before @ w + after @ w.T for (before, after), w in zip(beside, weights[1:]))
        p = np.exp(s - s.max(axis=1, keepdims=True))
        g = (target - p / p.sum(axis=1, keepdims=True)) / len(x)
        grads = [x.T @ g, *(before.T @ g + g.T @ after for before, after in beside)]
        grads[3] = (grads[3] + grads[3].T) / 2  # either of two mentions may come first
        for w, v, d in zip(weights, speed, grads):
            v *= 0.9
            v += d - 2e-4 * w
            w += 0.5 * v
    return SkipChain(*weights)


def node_features(text: str, toks: list[tuple[int, int]]) -> list[list[float]]:
    return [features(text[a:b], text[max(0, a - 48) : a]) for a, b in toks]


def _plausible(text: str, kind: int) -> bool:
    n = len(_DIGITS.findall(text))
    return (bool(re.fullmatch(r"[^@\s]+@[^@\s]+", text)), 4 <= n <= 12 and len(re.split(r"[^0-9]+", text)) == 4, 13 <= n <= 19, 10 <= n <= 15 and not re.search(r"[A-Za-z]", text))[kind]


def find(texts: list[str], field: SkipChain) -> list[tuple[list, list]]:
    """Base spans and all spans of each text. Texts share a graph, without edges between them, up to ``GRAPH_TOKENS``."""
    out: list[tuple[list, list]] = []
    held: list[tuple[int, str, list, list]] = []
    size = 0
    for k, t in enumerate(texts):
        base, toks = base_spans(t), tokens(t)
        out.append((base, list(base)))
        if toks:
            held.append((k, t, base, toks))
            size += len(toks)
        if held and (size >= GRAPH_TOKENS or k + 1 == len(texts)):
            for (at, *_), more in zip(held, _added(held, field)):
                out[at][1].extend(more)
            held, size = [], 0
    if held:
        for (at, *_), more in zip(held, _added(held, field)):
            out[at][1].extend(more)
    return [(b, sorted(s, key=lambda x: (x[0], x[2], x[1]))) for b, s in out]


def _added(held: list[tuple[int, str, list, list]], field: SkipChain) -> list[list[tuple[int, int, int]]]:
    """The spans that the field adds to each text."""
    seen, xs, edges, part, first = [], [], [], [], [0]
    for k, (_, t, base, toks) in enumerate(held):
        edges += [(a + first[-1], b + first[-1], kind) for a, b, kind in graph(t, toks, base)]
        xs += node_features(t, toks)
        part += [k] * len(toks)
        first.append(first[-1] + len(toks))
        j = 0
        for a, b in toks:
            while j < len(base) and base[j][1] <= a:
                j += 1
            hit = next((x for x in base[j : j + 8] if x[0] < b and a < x[1]), None)
            seen.append(hit[2] + 1 if hit else -1)
    p = field.marginals(np.array(xs), np.array(seen), edges, np.array(part))
    label = np.where((p.max(axis=1) >= SURE) & (np.array(seen) < 0), p.argmax(axis=1), 0).tolist()
    beside = {b: a for a, b, kind in edges if kind == BESIDE}
    out = []
    for n, (_, t, base, toks) in enumerate(held):
        found, k = [], first[n]
        while k < first[n + 1]:
            kind, e = label[k] - 1, k
            a = toks[k - first[n]][0]
            # parts of one number stand side by side; a number that is whole ends before one that is whole itself
            while kind > 0 and e + 1 < first[n + 1] and beside.get(e + 1) == e and label[e + 1] == label[k]:
                nxt = toks[e + 1 - first[n]]
                if _plausible(t[a : toks[e - first[n]][1]], kind) and (kind == 1 or not _plausible(t[a : nxt[1]], kind)):
                    break
                e += 1
            b = toks[e - first[n]][1]
            if kind >= 0 and _plausible(t[a:b], kind) and not any(x < b and a < y for x, y, _ in base):
                found.append((a, b, kind))
            k = e + 1
        out.append(found)
    return out


def _shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


#: Texts without any of these hold no base span and no token of the field; they stay out of Python.
_ANY = "[0-9@]"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)``, one row per document.

    Offsets count code points. Null and empty texts have no spans; repeated rows are searched each; other
    columns are not looked at. No shuffle.
    """
    ship(docs.sparkSession)
    field = trained()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, every = zip(*find([t or "" for t in b.column(1).to_pylist()], field)) if b.num_rows else ((), ())
            counts = [pa.array([sum(s[2] == k for s in x) for x in base], pa.int64()) for k in range(4)]
            digest = [hashlib.sha256(_shown(x).encode()).hexdigest() for x in base]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(digest, pa.string()), pa.array([_shown(x) for x in every], pa.string())], names)

    text = F.when(F.col(text_col).rlike(_ANY), F.col(text_col)).alias("text")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span as [KIND]; overlapping spans as one, of the first span's kind."""
    out, done = [], 0
    merged: list[list[int]] = []
    for a, b, k in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, k])
    for a, b, k in merged:
        out += [text[done:a], f"[{KINDS[k].upper()}]"]
        done = b
    return "".join([*out, text[done:]])


def mask_personal_data(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span masked and ``length_col`` (if there) set to the new length in code points.

    Null texts stay null, with a null length, and empty ones empty; repeated rows are masked alike; other columns pass
    through whatever their names; no row goes. No shuffle.
    """
    ship(docs.sparkSession)
    field = trained()
    n = docs.columns.index(text_col)
    m = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(n).to_pylist()
            at = [k for k, t in enumerate(texts) if t and ("@" in t or _DIGITS.search(t))]
            for k, (_, spans) in zip(at, find([texts[k] for k in at], field)):
                if spans:
                    texts[k] = masked(texts[k], spans)
            cols = list(b.columns)
            cols[n] = pa.array(texts, b.schema.field(n).type)
            if m is not None:
                cols[m] = pa.array([None if t is None else len(t) for t in texts], b.schema.field(m).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def op9(spark, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
