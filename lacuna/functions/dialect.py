"""RE2 patterns in Java's regular-expression syntax, with the same meaning."""

from __future__ import annotations

from functools import cache

_W = "[0-9A-Za-z_]"
#: A word boundary over ASCII word characters; Java's own looks at all of Unicode.
_BOUNDARY = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"
_SPACE = r"\t\n\f\r "


@cache
def to_java(pattern: str) -> str:
    r"""``\b``, ``\s``, ``$``, ``(?i)`` and ``[`` within a class mean other things in Java."""
    out, k, inside = [], 0, False
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two == r"\b" and not inside:
            out.append(_BOUNDARY)
            k += 2
        elif two == r"\s":
            out.append(_SPACE if inside else f"[{_SPACE}]")
            k += 2
        elif pattern[k] == "\\":
            out.append(two)
            k += 2
        elif inside:
            out.append(r"\[" if pattern[k] == "[" else pattern[k])
            inside = pattern[k] != "]"
            k += 1
        elif pattern[k] == "[":
            out.append("[")
            inside = True
            k += 1
        elif pattern.startswith("(?i)", k):
            out.append("(?iu)")
            k += 4
        elif pattern[k] == "$":
            out.append(r"\z")
            k += 1
        else:
            out.append(pattern[k])
            k += 1
    return "".join(out)
