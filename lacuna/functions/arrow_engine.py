"""The pattern and secret stages over Arrow batches: a second implementation, for SQL functions and as a cross-check.

It finds the same spans as the expressions of :mod:`lacuna.operators.detect`. Patterns run in Python with ASCII
classes, secrets line by line.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache

from lacuna.operators.detect import _STEMS
from lacuna.operators.ruleset import ALL_TYPES, CALLING_CODES, PATTERNS, RULES, Rule, by_priority

Found = tuple[str, int, int]  # type, start, end in code points


def to_python(pattern: str) -> str:
    """RE2 syntax in Python's: ``\\s`` and ``$`` mean other things there, and ``[`` within a class is escaped."""
    out, k, inside = [], 0, False
    while k < len(pattern):
        c, two = pattern[k], pattern[k : k + 2]
        if c == "\\":
            out.append((r"\t\n\f\r " if inside else r"[\t\n\f\r ]") if two == r"\s" else two)
            k += 2
            continue
        if inside:
            out.append(r"\[" if c == "[" else c)
            inside = c != "]"
        else:
            out.append(r"\Z" if c == "$" else c)
            inside = c == "["
        k += 1
    return "".join(out)


@cache
def _compiled(pattern: str) -> re.Pattern:
    flags = re.A
    while pattern.startswith(("(?i)", "(?s)")):
        flags |= re.I if pattern[2] == "i" else re.S
        pattern = pattern[4:]
    return re.compile(to_python(pattern), flags)


def luhn(s: str) -> bool:
    d = [int(c) for c in s if c in "0123456789"]
    return len(d) >= 13 and sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(reversed(d))) % 10 == 0


def iban(s: str) -> bool:
    if not 15 <= len(s) <= 34 or not all(c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in s):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def phone(s: str) -> bool:
    d = "".join(c for c in s if c in "0123456789")
    if not s.lstrip().startswith("+"):
        return len(d) in (7, 10)
    return any(d[:n] in CALLING_CODES and CALLING_CODES[d[:n]][0] <= len(d) - n <= CALLING_CODES[d[:n]][1] for n in (1, 2, 3))


CHECKS = {"luhn": luhn, "iban": iban, "phone": phone}


def entropy(s: str) -> float:
    n = len(s.encode())
    return -sum(k / n * math.log2(k / n) for k in Counter(s).values()) if n else 0.0


def _alone(value: str, word: str) -> bool:
    """The word stands between characters other than ``[a-z0-9_]``; after a failed place, the rest is looked at afresh."""
    at = value.find(word)
    while at >= 0:
        end = at + len(word)
        if (at == 0 or not re.match("[a-z0-9_]", value[at - 1])) and (end == len(value) or not re.match("[a-z0-9_]", value[end])):
            return True
        value = value[at + 1 :]
        at = value.find(word)
    return False


def accepted(value: str, rule: Rule) -> bool:
    a = rule.allow
    if rule.entropy and entropy(value) < rule.entropy or value in a.exact or a.regex and _compiled(a.regex).search(value):
        return False
    return not any(_alone(value.lower(), w) for w in a.stop_words)


def pattern_stage(text: str) -> list[Found]:
    taken: list[Found] = []
    for p in by_priority(PATTERNS):
        if p.needs and not any(n in text for n in p.needs):
            continue
        for m in _compiled(p.regex).finditer(text):
            if all(m.end() <= a or b <= m.start() for _, a, b in taken) and (not p.validator or CHECKS[p.validator](m.group())):
                taken.append((p.type, *m.span()))
    return sorted(taken, key=lambda f: f[1])


def secret_stage(text: str, taken: list[Found]) -> list[Found]:
    claimed = [(a, b) for _, a, b in taken]
    lines, at = [], 0
    for line in text.split("\n"):
        whole = line + "\n" if at + len(line) < len(text) else line
        if whole:
            lines.append((at, whole, whole.lower()))
        at += len(whole)
    found: list[Found] = []
    for r in RULES:
        for at, line, low in lines:
            if r.needs and not any(n in line for n in r.needs) or r.context and not any(w in low for w in r.context) or r.type in _STEMS and not any(s in low for s in _STEMS[r.type]):
                continue
            for m in _compiled(r.regex).finditer(line):
                a, b = at + m.start(), at + m.end()
                if all(b <= x or y <= a for x, y in claimed) and accepted(m.group(2), r):
                    claimed.append((a, b))
                    found.append((r.type, at + m.start(2), at + m.end(2)))
    return sorted(found, key=lambda f: f[1])


def spans(text: str, disabled: tuple[str, ...] = ()) -> list[Found]:
    known = set(ALL_TYPES) - set(disabled)
    one = [f for f in pattern_stage(text) if f[0] in known]
    return sorted([*one, *(f for f in secret_stage(text, one) if f[0] in known)], key=lambda f: f[1])


def redact(text: str, disabled: tuple[str, ...] = ()) -> str:
    out, at = [], 0
    for kind, a, b in spans(text, disabled):
        if a >= at:
            out += [text[at:a], f"[REDACTED - {kind}]"]
            at = b
    return "".join([*out, text[at:]])
