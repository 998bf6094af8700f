"""Column building blocks: one evaluation for many uses, pattern scans, folds over spans.

A span is ``struct<type, start, end, text, cstart, cend>``: byte offsets are the contract, offsets in code points
serve slicing. Everything here is a plain expression: no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Private-use characters that mark matches; those of a text itself are first moved to others of the same length.
OPEN, SECRET, AFTER, CLOSE = "\ue000", "\ue001", "\ue002", "\ue003"
_ASIDE = "\ue004\ue005\ue006\ue007"
HIT = "struct<s:int,e:int,cs:int,ce:int>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def none_of(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _hits(pieces: Column, inside: str) -> Column:
    """Spans of the pieces at odd places, from running lengths in bytes and code points."""
    zero = F.lit(0)
    start = F.struct(zero.alias("b"), zero.alias("c"), F.lit(False).alias("in"), none_of(HIT).alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        b, c = acc["b"] + F.octet_length(piece), acc["c"] + F.length(piece)
        hit = F.struct(acc["b"].alias("s"), b.alias("e"), acc["c"].alias("cs"), c.alias("ce"))
        return F.struct(b.alias("b"), c.alias("c"), (~acc["in"]).alias("in"), F.when(acc["in"], F.array_append(acc["out"], hit)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pieces, start, step, lambda acc: acc["out"])


def unmarked(text: Column) -> Column:
    """The text with its own marks moved aside: what the scans take. Offsets and lengths stay the same."""
    return F.when(text.rlike(f"[{OPEN}{SECRET}{AFTER}{CLOSE}]"), F.translate(text, OPEN + SECRET + AFTER + CLOSE, _ASIDE)).otherwise(text)


def find_all(clean: Column, java: str | Column) -> Column:
    """All leftmost non-overlapping matches in an unmarked text as ``array<struct<s,e,cs,ce>>`` (bytes, code points)."""
    marked = F.regexp_replace(clean, F.lit(java) if isinstance(java, str) else java, F.lit(f"{OPEN}$0{CLOSE}"))
    return let(marked, lambda m: F.when(F.contains(m, F.lit(OPEN)), _hits(F.split(m, f"[{OPEN}{CLOSE}]", -1), HIT)).otherwise(none_of(HIT)))


def find_parts(clean: Column, java: str) -> Column:
    """As :func:`find_all` for a pattern of three groups: adds the span of the second as ``ss, se, scs, sce``."""
    marked = F.regexp_replace(clean, F.lit(java), F.lit(f"{OPEN}$1{SECRET}$2{AFTER}$3{CLOSE}"))
    kind = "struct<s:int,e:int,cs:int,ce:int,ss:int,se:int,scs:int,sce:int>"
    return let(marked, lambda m: F.when(F.contains(m, F.lit(OPEN)), _parts(m)).otherwise(none_of(kind)))


def _parts(marked: Column) -> Column:
    pieces = F.split(marked, f"[{OPEN}{SECRET}{AFTER}{CLOSE}]", -1)  # outside, before, secret, after, outside, ...
    ends = F.aggregate(
        pieces,
        F.struct(F.array(F.lit(0)).alias("b"), F.array(F.lit(0)).alias("c")),
        lambda a, p: F.struct(F.array_append(a["b"], F.element_at(a["b"], -1) + F.octet_length(p)).alias("b"), F.array_append(a["c"], F.element_at(a["c"], -1) + F.length(p)).alias("c")),
    )
    at = lambda e, f, k, d: F.element_at(e[f], k * 4 + d)

    def spans(e: Column) -> Column:
        n = ((F.size(e["b"]) - 2) / 4).cast("int")
        one = lambda k: F.struct(
            at(e, "b", k, 2).alias("s"), at(e, "b", k, 5).alias("e"), at(e, "c", k, 2).alias("cs"), at(e, "c", k, 5).alias("ce"),
            at(e, "b", k, 3).alias("ss"), at(e, "b", k, 4).alias("se"), at(e, "c", k, 3).alias("scs"), at(e, "c", k, 4).alias("sce"),
        )
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(none_of("struct<s:int,e:int,cs:int,ce:int,ss:int,se:int,scs:int,sce:int>"))

    return let(ends, spans)


def overlap(a: Column, b: Column, start: str = "start", end: str = "end") -> Column:
    """Half-open spans overlap; touching ones do not."""
    return (a[start] < b[end]) & (b[start] < a[end])


def claim(candidates: Column, kind: str, start: str, end: str, taken: Column | None = None) -> Column:
    """In order, keeps each candidate that overlaps none kept before (nor any of ``taken``)."""
    clear = lambda acc, c: ~F.exists(acc, lambda x: overlap(x, c, start, end))
    if taken is not None:
        candidates = F.filter(candidates, lambda c: clear(taken, c))
    return F.aggregate(candidates, none_of(kind), lambda acc, c: F.when(clear(acc, c), F.array_append(acc, c)).otherwise(acc))


def any_contains(text: Column, needles: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(text, F.lit(n))
    return out
