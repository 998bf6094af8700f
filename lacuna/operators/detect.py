"""Detectors as expressions over a text column: pattern stage and secret stage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lacuna.functions.columns import HIT, any_contains, claim, find_all, find_parts, let, none_of, unmarked
from lacuna.functions.dialect import to_java
from lacuna.functions.validators import VALIDATORS, shannon_entropy

from .ruleset import PATTERNS, RULES, Allowlist, Pattern, Rule, by_priority

SPAN = "struct<type:string,start:int,end:int,text:string,cstart:int,cend:int>"
_FULL = "struct<type:string,start:int,end:int,text:string,cstart:int,cend:int,fs:int,fe:int>"


def _cut(text: Column, a: Column, b: Column) -> Column:
    return F.substring(text, a + 1, b - a)


def pattern_spans(text: Column, pattern: Pattern, clean: Column | None = None) -> Column:
    """Valid matches of one pattern, in document order. A match that fails its check still uses up its text."""
    if clean is None:
        return let(unmarked(text), lambda c: pattern_spans(text, pattern, c))
    java = to_java(pattern.regex)
    hits = F.transform(
        find_all(clean, f"(?={pattern.first}){java}" if pattern.first else java),
        lambda h: F.struct(F.lit(pattern.type).alias("type"), h["s"].alias("start"), h["e"].alias("end"), _cut(text, h["cs"], h["ce"]).alias("text"), h["cs"].alias("cstart"), h["ce"].alias("cend")),
    )
    if pattern.validator:
        hits = F.filter(hits, lambda h: VALIDATORS[pattern.validator](h["text"]))
    gate = F.lit(True)
    if pattern.needs:
        gate = gate & any_contains(text, pattern.needs)
    if pattern.hint:
        gate = gate & text.rlike(pattern.hint)
    return F.when(gate, hits).otherwise(none_of(SPAN))


def pattern_stage(text: Column, patterns: tuple[Pattern, ...] = PATTERNS) -> Column:
    """Spans of all patterns: by priority, then position, each claims its text; returned in document order."""
    found = let(unmarked(text), lambda clean: F.concat(*(pattern_spans(text, p, clean) for p in by_priority(patterns))))
    return let(found, lambda c: F.when(F.size(c) <= 1, c).otherwise(in_order(claim(c, SPAN, "start", "end"))))


def in_order(spans: Column) -> Column:
    return F.array_sort(spans, lambda a, b: a["start"] - b["start"])


# -- secrets ------------------------------------------------------------------------------------------------


def stop_word_pattern(words: tuple[str, ...]) -> str:
    """Java pattern: one of the words stands alone, between characters other than ``[a-z0-9_]``.

    A word of one repeated character also counts at the end of a longer run of it.
    """
    parts = []
    for w in words:
        glued = f"(?<={w[0]})|" if len(set(w)) == 1 and len(w) > 1 else ""
        parts.append(f"(?:{glued}(?<![a-z0-9_])){w}(?![a-z0-9_])")
    return "|".join(parts)


def suppressed(secret: Column, allow: Allowlist) -> Column:
    """The allowlist names the value, matches it, or one of its stop words stands alone in it."""
    out = F.lit(False)
    if allow.exact:
        out = out | secret.isin(*allow.exact)
    if allow.regex:
        out = out | secret.rlike(to_java(allow.regex))
    if allow.stop_words:
        out = out | F.lower(secret).rlike(stop_word_pattern(allow.stop_words))
    return out


def _line_has(text: Column, a: Column, b: Column, words: tuple[str, ...]) -> Column:
    line = F.concat(F.substring_index(F.substring(text, F.lit(1), a), "\n", -1), F.substring_index(F.substring(text, a + 1, F.length(text)), "\n", 1))
    return any_contains(F.lower(line), words)


#: Strings (lower case) of which a text with a generic or Heroku secret holds one.
_STEMS = {"PASSWORD": ("pass",), "GENERIC_API_KEY": ("access", "auth", "api", "credential", "creds", "key", "secret", "token"), "HEROKU_API_KEY": ("heroku",)}


def rule_spans(text: Column, rule: Rule, low: Column, clean: Column) -> Column:
    """Candidates of one rule in document order: redacted span, and the full match (fs, fe) that it claims."""
    if rule.before:
        hits = F.transform(
            find_parts(clean, to_java(rule.regex)),
            lambda h: F.struct(
                F.lit(rule.type).alias("type"), h["ss"].alias("start"), h["se"].alias("end"), _cut(text, h["scs"], h["sce"]).alias("text"), h["scs"].alias("cstart"), h["sce"].alias("cend"), h["s"].alias("fs"), h["e"].alias("fe"),
            ),
        )
    else:
        hits = F.transform(
            find_all(clean, to_java(rule.secret)),
            lambda h: F.struct(F.lit(rule.type).alias("type"), h["s"].alias("start"), h["e"].alias("end"), _cut(text, h["cs"], h["ce"]).alias("text"), h["cs"].alias("cstart"), h["ce"].alias("cend"), h["s"].alias("fs"), h["e"].alias("fe")),
        )
    if rule.context:
        hits = F.filter(hits, lambda h: _line_has(text, h["cstart"], h["cend"], rule.context))
    gate = any_contains(low, _STEMS[rule.type]) if rule.type in _STEMS else any_contains(text, rule.needs)
    if rule.type in ("PASSWORD", "GENERIC_API_KEY"):
        gate = gate & text.rlike("[=>:|,]")  # every match holds an assignment operator
    return F.when(gate, hits).otherwise(none_of(_FULL))


def accepted(span: Column, rule: Rule) -> Column:
    out = F.lit(True)
    if rule.entropy:
        out = out & (shannon_entropy(span["text"]) >= rule.entropy)
    if rule.allow != Allowlist():
        out = out & ~suppressed(span["text"], rule.allow)
    return out


def _plain(r: Rule) -> bool:
    """The rule's match is its secret, and nothing but entropy, exact values and context decide on it."""
    return not r.before and not r.allow.regex and not r.allow.stop_words


def _rule_table(rules: tuple[Rule, ...]) -> Column:
    """Plain rules as an array of structs, so that the plan holds one scan for all of them."""
    words = lambda ws: F.array(*map(F.lit, ws)) if ws else none_of("string")
    return F.array(
        *(
            F.struct(
                F.lit(k).alias("ord"), F.lit(r.type).alias("type"), F.lit(to_java(r.secret)).alias("regex"), words(r.needs).alias("needs"), F.lit(float(r.entropy)).alias("entropy"),
                words(r.context).alias("context"), words(r.allow.exact).alias("exact"),
            )
            for k, r in enumerate(rules)
            if _plain(r)
        )
    )


_ORDERED = "struct<ord:int,fs:int,fe:int,type:string,start:int,end:int,text:string,cstart:int,cend:int>"
_SPAN_FIELDS = ("type", "start", "end", "text", "cstart", "cend")


def plain_rule_spans(text: Column, rules: tuple[Rule, ...], clean: Column) -> Column:
    """Accepted matches of all plain rules. Only rules of which a needed string is there are tried."""
    tried = F.filter(_rule_table(rules), lambda r: F.exists(r["needs"], lambda n: F.contains(text, n)))

    def hits(r: Column) -> Column:
        found = F.transform(find_all(clean, r["regex"]), lambda h: F.struct(
            r["ord"].alias("ord"), h["s"].alias("fs"), h["e"].alias("fe"), r["type"].alias("type"), h["s"].alias("start"), h["e"].alias("end"), _cut(text, h["cs"], h["ce"]).alias("text"), h["cs"].alias("cstart"), h["ce"].alias("cend")))

        def keep(h: Column) -> Column:
            line = F.lower(F.concat(F.substring_index(F.substring(text, F.lit(1), h["cstart"]), "\n", -1), F.substring_index(F.substring(text, h["cstart"] + 1, F.length(text)), "\n", 1)))
            near = (F.size(r["context"]) == 0) | F.exists(r["context"], lambda w: F.contains(line, w))
            return near & (shannon_entropy(h["text"]) >= r["entropy"]) & ~F.array_contains(r["exact"], h["text"])

        return F.filter(found, keep)

    return F.flatten(F.transform(tried, hits))


#: One look tells whether any secret rule can match at all: prefixes and stems.
def _any_secret(text: Column, low: Column, rules: tuple[Rule, ...]) -> Column:
    needs = F.array(*(F.lit(n) for r in rules for n in r.needs))
    stems = F.array(*(F.lit(s) for r in rules for s in _STEMS.get(r.type, ("\u0000 never",))))
    return F.exists(needs, lambda n: F.contains(text, n)) | F.exists(stems, lambda s: F.contains(low, s))


def secret_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Accepted matches of all rules, by declaration order, then position."""
    order = lambda k: lambda h: F.struct(F.lit(k).alias("ord"), h["fs"].alias("fs"), h["fe"].alias("fe"), *(h[f].alias(f) for f in _SPAN_FIELDS))

    def every(low: Column, clean: Column) -> Column:
        passing = lambda rule: F.filter(rule_spans(text, rule, low, clean), lambda h: accepted(h, rule))
        parts = [F.transform(passing(r), order(k)) for k, r in enumerate(rules) if not _plain(r)]
        if any(map(_plain, rules)):
            parts.append(plain_rule_spans(text, rules, clean))
        return F.sort_array(F.concat(*parts))

    return let(F.lower(text), lambda low: F.when(_any_secret(text, low, rules), let(unmarked(text), lambda clean: every(low, clean))).otherwise(none_of(_ORDERED)))


def secret_stage(text: Column, taken: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans of all rules in declaration order. A match claims all its text, though only the secret is a span;
    it is passed over where its text overlaps ``taken`` or an earlier claim, or where the secret is not accepted."""

    def claims(c: Column) -> Column:
        free = F.filter(c, lambda h: ~F.exists(taken, lambda t: (h["fs"] < t["end"]) & (t["start"] < h["fe"])))
        return in_order(F.transform(claim(free, _ORDERED, "fs", "fe"), lambda h: F.struct(*(h[k].alias(k) for k in _SPAN_FIELDS))))

    return let(secret_spans(text, rules), lambda c: F.when(F.size(c) == 0, none_of(SPAN)).otherwise(claims(c)))


__all__ = ["HIT", "SPAN", "accepted", "in_order", "pattern_spans", "pattern_stage", "rule_spans", "secret_spans", "secret_stage", "stop_word_pattern", "suppressed"]
