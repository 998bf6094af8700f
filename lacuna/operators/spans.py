"""Algebra over arrays of spans: merge, filter, cover, gaps, rewrite, joins of neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.functions.columns import claim, let, none_of, overlap
from lacuna.functions.dialect import to_java

from .detect import SPAN, in_order


def merge(claimed: Column, incoming: Column) -> Column:
    """All claimed spans and those incoming ones that overlap none of them, in document order."""
    fresh = F.filter(incoming, lambda m: ~F.exists(claimed, lambda c: overlap(c, m)))
    return F.when(F.size(incoming) == 0, claimed).otherwise(in_order(F.concat(claimed, fresh)))


def merge_exploded(claimed: DataFrame, incoming: DataFrame) -> DataFrame:
    """The same as rows: an overlap anti-join, hashed by document (claimed, incoming: doc_id, start, end, type)."""
    c = claimed.select("doc_id", F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    near = (incoming["doc_id"] == c["doc_id"]) & (F.col("c_start") < F.col("end")) & (F.col("start") < F.col("c_end"))
    return claimed.unionByName(incoming.join(c, near, "left_anti"))


def only_types(spans: Column, enabled: tuple[str, ...]) -> Column:
    """Spans of enabled types; unknown types go."""
    return F.filter(spans, lambda m: m["type"].isin(*enabled)) if enabled else none_of(SPAN)


def fully_covered(text: Column, spans: Column) -> Column:
    """The spans, in order, leave no byte of the text uncovered; never without spans."""
    end = F.aggregate(in_order(spans), F.lit(0), lambda a, s: F.when((a < 0) | (s["start"] > a), F.lit(-1)).otherwise(F.greatest(a, s["end"])))
    return F.when(F.size(spans) == 0, F.lit(False)).otherwise(end >= F.octet_length(text))


def redact(text: Column, spans: Column) -> Column:
    """Each span as ``[REDACTED - TYPE]``; of overlapping spans, the leftmost."""

    def rewrite(kept: Column) -> Column:
        before = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(kept, k - 1)["cend"])
        parts = F.transform(kept, lambda s, k: let(before(k), lambda at: F.concat(F.substring(text, at + 1, s["cstart"] - at), F.lit("[REDACTED - "), s["type"], F.lit("]"))))
        return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(kept, -1)["cend"] + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(claim(in_order(spans), SPAN, "start", "end"), rewrite))


def gaps(text: Column, spans: Column) -> Column:
    """What no span covers, without white space around, blank stretches left out: ``array<struct<start, cstart, text>>``."""
    zero = F.struct(F.lit(0).alias("b"), F.lit(0).alias("c"), none_of("struct<b:int,c:int,e:int>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = F.struct(a["b"].alias("b"), a["c"].alias("c"), s["cstart"].alias("e"))
        return F.struct(F.greatest(a["b"], s["end"]).alias("b"), F.greatest(a["c"], s["cend"]).alias("c"), F.when(s["start"] > a["b"], F.array_append(a["out"], gap)).otherwise(a["out"]).alias("out"))

    tail = lambda a: F.array_append(a["out"], F.struct(a["b"].alias("b"), a["c"].alias("c"), F.length(text).alias("e")))
    space = r"[\s\x{85}\p{Z}]"

    def trimmed(g: Column) -> Column:
        raw = F.substring(text, g["c"] + 1, g["e"] - g["c"])
        front = F.regexp_extract(raw, f"^({space}*)", 1)
        return F.struct((g["b"] + F.octet_length(front)).alias("start"), (g["c"] + F.length(front)).alias("cstart"), F.regexp_replace(raw, f"^{space}+|{space}+\\z", "").alias("text"))

    return F.filter(F.transform(F.aggregate(in_order(spans), zero, step, tail), trimmed), lambda g: g["text"] != "")


# What may stand between two spans of one entity, and a house number before an address.
CONNECTOR = r"^,?\s*[A-Z0-9]{0,6}\s*,?\s*$"
HOUSE_NUMBER = r"(?:^|\s)(\d{1,6}[A-Za-z]?)\s*$"


def merge_adjacent(text: Column, spans: Column) -> Column:
    """Joins consecutive spans of one type where only a connector stands between them (byte and code point ends)."""

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        between = F.substring(text, last["cend"] + 1, s["cstart"] - last["cend"])
        joined = F.struct(last["type"].alias("type"), last["start"].alias("start"), s["end"].alias("end"), F.substring(text, last["cstart"] + 1, s["cend"] - last["cstart"]).alias("text"), last["cstart"].alias("cstart"), s["cend"].alias("cend"))
        fits = (last["type"] == s["type"]) & between.rlike(to_java(CONNECTOR))
        return F.when(F.size(acc) == 0, F.array(s)).when(fits, F.array_append(F.slice(acc, 1, F.size(acc) - 1), joined)).otherwise(F.array_append(acc, s))

    return F.aggregate(spans, none_of(SPAN), step)


def extend_house_numbers(text: Column, spans: Column) -> Column:
    """Moves the start of an address back over a house number before it."""

    def extend(s: Column) -> Column:
        before = F.substring(text, F.lit(1), s["cstart"])
        number = F.regexp_extract(before, to_java(HOUSE_NUMBER), 1)
        back = F.length(F.regexp_extract(before, to_java(r"(\d{1,6}[A-Za-z]?\s*)$"), 1))
        size = F.when(number == "", F.lit(0)).otherwise(F.length(number) + F.length(F.regexp_extract(before, to_java(r"(\s*)$"), 1)))
        moved = F.struct(
            s["type"].alias("type"), (s["start"] - F.octet_length(F.substring(text, s["cstart"] - size + 1, size))).alias("start"), s["end"].alias("end"),
            F.substring(text, s["cstart"] - size + 1, s["cend"] - s["cstart"] + size).alias("text"), (s["cstart"] - size).alias("cstart"), s["cend"].alias("cend"),
        )
        return F.when((s["type"] == "ADDRESS") & (size > 0) & (back >= size), moved).otherwise(s)

    return F.transform(spans, extend)


def explode_spans(df: DataFrame, spans: str = "spans") -> DataFrame:
    """One row per span. (An outer explode and a later filter: else the optimizer would evaluate the spans a second
    time, to filter rows before it explodes them.)"""
    return df.select("doc_id", F.explode_outer(spans).alias("m")).where("m is not null").select("doc_id", "m.type", "m.start", "m.end", "m.text")


def split_lines(text: Column) -> Column:
    """Lines with their line feed and byte offset: ``array<struct<start, line>>``; an empty tail is dropped."""
    lines = F.filter(F.split(text, r"(?<=\n)", -1), lambda x: x != "")
    start = F.struct(F.lit(0).alias("at"), none_of("struct<start:int,line:string>").alias("out"))
    return F.aggregate(lines, start, lambda a, x: F.struct((a["at"] + F.octet_length(x)).alias("at"), F.array_append(a["out"], F.struct(a["at"].alias("start"), x.alias("line"))).alias("out")), lambda a: a["out"])


def best_by_score(spans: Column, kind: str) -> Column:
    """Greedily by falling score (ties: by start), without overlaps, then by start.

    What is kept lies in bins by start, at least as wide as the longest span, so that only three bins can overlap a span.
    """
    ranked = F.array_sort(spans, lambda a, b: F.when(a["score"] != b["score"], F.signum(b["score"] - a["score"]).cast("int")).otherwise(a["start"] - b["start"]))
    least, most = F.array_min(F.transform(spans, lambda s: s["start"])), F.array_max(F.transform(spans, lambda s: s["start"]))
    wide = F.greatest(F.array_max(F.transform(spans, lambda s: s["end"] - s["start"])), F.ceil((most - least) / 256).cast("int"), F.lit(1))
    grid = F.struct(least.alias("from"), wide.alias("wide"), (F.floor((most - least) / wide) + 3).cast("int").alias("n"))

    def fold(g: Column) -> Column:
        def step(bins: Column, s: Column) -> Column:
            at = F.floor((s["start"] - g["from"]) / g["wide"]).cast("int") + 2  # an empty bin on either side
            clear = ~F.exists(F.flatten(F.slice(bins, at - 1, 3)), lambda x: overlap(x, s))
            more = F.concat(F.slice(bins, F.lit(1), at - 1), F.array(F.array_append(F.element_at(bins, at), s)), F.slice(bins, at + 1, g["n"]))
            return F.when(clear, more).otherwise(bins)

        return in_order(F.flatten(F.aggregate(ranked, F.array_repeat(none_of(kind), g["n"]), step)))

    return F.when(F.size(spans) == 0, none_of(kind)).otherwise(let(grid, fold))


def first_spans(spans: Column, most: int = 32) -> Column:
    """The first ``most`` spans by start."""
    return F.slice(in_order(spans), 1, most)


def gaps_as_rows(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Byte gaps as rows, from a running maximum of ends: ``(doc_id, start, end)``; documents hash by id."""
    w = W.partitionBy("doc_id").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    ends = docs.select("doc_id", F.octet_length("text").alias("start"), F.octet_length("text").alias("end"))
    every = spans.select("doc_id", "start", "end").unionByName(ends)
    return every.withColumn("from", F.coalesce(F.max("end").over(w), F.lit(0))).where("start > from").select("doc_id", F.col("from").alias("start"), F.col("start").alias("end"))
