"""Evaluation of spans: alignment of redacted texts, greedy matching, precision, recall and F1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.columns import let, none_of

from .ruleset import NER_TYPES

MARKER = r"\[REDACTED - ([A-Za-z0-9_]+)\]"


def align_golden(text: Column, expected: Column) -> Column:
    """Spans ``array<struct<start,end,type>>`` (code points) of what the markers in ``expected`` stand for.

    The literal stretches between markers are found from left to right; an empty last stretch means to the end. If
    one is not there, the spans are those of the markers, each moved left by the markers before it.
    """
    kind = "struct<start:int,end:int,type:string>"
    types = F.regexp_extract_all(expected, F.lit(MARKER), F.lit(1))
    segments = F.split(expected, MARKER, -1)

    def align(segs: Column) -> Column:
        head = F.element_at(segs, 1)
        pairs = F.arrays_zip(types.alias("t"), F.slice(segs, 2, F.size(types)).alias("s"))
        init = F.struct(F.length(head).alias("pos"), F.startswith(text, head).alias("ok"), none_of(kind).alias("out"))

        def step(a: Column, x: Column) -> Column:
            at = F.when(x["s"] == "", F.length(text)).otherwise(_locate(x["s"], text, a["pos"]))
            span = lambda e: F.struct(a["pos"].alias("start"), e.alias("end"), x["t"].alias("type"))
            return let(at, lambda e: F.struct((e + F.length(x["s"])).alias("pos"), (a["ok"] & (e >= a["pos"])).alias("ok"), F.array_append(a["out"], span(e)).alias("out")))

        def fallback(a: Column) -> Column:
            start = F.struct(F.length(head).alias("at"), none_of(kind).alias("out"))
            size = lambda t: F.length(t) + F.length(F.lit("[REDACTED - ]"))
            return F.aggregate(pairs, start, lambda b, x: F.struct((b["at"] + F.length(x["s"])).alias("at"), F.array_append(b["out"], F.struct(b["at"].alias("start"), (b["at"] + size(x["t"])).alias("end"), x["t"].alias("type"))).alias("out")), lambda b: b["out"])

        return F.aggregate(pairs, init, step, lambda a: F.when(a["ok"], a["out"]).otherwise(fallback(a)))

    return let(segments, align)


def _locate(needle: Column, text: Column, pos: Column) -> Column:
    """Place of ``needle`` at or after ``pos`` (both from 0); -1 if it is not there."""
    return F.call_function("locate", needle, text, pos + 1) - 1


def match_spans(expected: Column, predicted: Column, typed: bool = True) -> Column:
    """Numbers (from 0) of the predicted spans matched, in order of the expected ones; -1 for none.

    Each expected span takes the first predicted one not yet taken that overlaps it (and has its type).
    """

    def step(acc: Column, e: Column) -> Column:
        fits = lambda p, k: ~F.array_contains(acc, k) & (e["start"] < p["end"]) & (p["start"] < e["end"]) & ((p["type"] == e["type"]) if typed else F.lit(True))
        first = F.array_min(F.filter(F.transform(predicted, lambda p, k: F.when(fits(p, k), k)), lambda k: k.isNotNull()))
        return F.array_append(acc, F.coalesce(first, F.lit(-1)))

    return F.aggregate(expected, none_of("int"), step)


def ratios(tp: Column, n_expected: Column, n_predicted: Column) -> dict[str, Column]:
    """Precision, recall and F1; 0 where undefined."""
    p, r = F.coalesce(F.try_divide(tp, n_predicted), F.lit(0.0)), F.coalesce(F.try_divide(tp, n_expected), F.lit(0.0))
    return {"precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))}


def prf(cases: DataFrame, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """One row per type and one (type null) over all, in one pass."""
    matched = cases.select(F.col(expected).alias("e"), F.col(predicted).alias("p")).select("e", "p", match_spans(F.col("e"), F.col("p")).alias("m"))
    row = lambda s, e, p, tp: F.struct(s["type"].alias("type"), F.lit(e).alias("e"), F.lit(p).alias("p"), tp.alias("tp"))
    rows = F.concat(F.transform(F.arrays_zip("e", "m"), lambda x: row(x["e"], 1, 0, (x["m"] >= 0).cast("int"))), F.transform("p", lambda x: row(x, 0, 1, F.lit(0))))
    tall = matched.select(F.explode_outer(rows).alias("x")).where("x is not null").select("x.*")
    sums = tall.rollup("type").agg(F.sum("tp").alias("tp"), F.sum("e").alias("n_expected"), F.sum("p").alias("n_predicted"))
    return sums.withColumns(ratios(F.col("tp"), F.col("n_expected"), F.col("n_predicted")))


def exact_prf(cases: DataFrame, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """As :func:`prf`, where only equal spans of equal type match."""
    same = F.array_intersect(*(F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"))) for c in (expected, predicted)))
    part = lambda c, k: cases.select(F.explode(c).alias("x")).select("x.type", F.lit(k).alias("k"))
    tall = part(F.col(expected), "e").unionByName(part(F.col(predicted), "p")).unionByName(part(same, "tp"))
    n = lambda k: F.sum((F.col("k") == k).cast("int"))
    sums = tall.rollup("type").agg(n("tp").alias("tp"), n("e").alias("n_expected"), n("p").alias("n_predicted"))
    return sums.withColumns(ratios(F.col("tp"), F.col("n_expected"), F.col("n_predicted")))


def gate(metrics: DataFrame, least_f1: float = 0.70) -> bool:
    """The quality gate on the row over all types."""
    row = metrics.where("type is null").first()
    return bool(row and row["f1"] >= least_f1)


def split_gold(spans: Column) -> tuple[Column, Column]:
    """Spans the model should find, and spans that earlier stages claim."""
    return F.filter(spans, lambda s: s["type"].isin(*NER_TYPES)), F.filter(spans, lambda s: ~s["type"].isin(*NER_TYPES))


def token_agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Share of equal labels."""
    return pairs.agg(F.count("*").alias("n_tokens"), F.sum((F.col(a) == F.col(b)).cast("long")).alias("n_equal"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement"))
